import pytest

import skein.plans  # noqa: F401
from skein.catalogue import QUERIES
from skein.text import measure, sections, segment
from skein.text.lexicon import Concept, Cue, Lexicon, has_capture, longest, union_matcher
from skein.text.mentions import Engine

LEXICON = Lexicon(
    [
        Concept("lung", "anatomy", ("lungs?",), takes_side=True), Concept("liver", "anatomy", ("liver",)), Concept("aorta", "anatomy", ("thoracic aorta", "aorta")), Concept("heart", "anatomy", ("heart",)),
        Concept("nodule", "observation", ("nodules?",)), Concept("lesion", "observation", ("lesions?", "space-occupying lesions?")), Concept("effusion", "observation", ("pleural effusion", "effusion")), Concept("thickening", "observation", ("thickening",)),
        Concept("infiltration", "observation", ("infiltration",)), Concept("calcific", "qualifier", ("calcified",)), Concept("hypodense", "qualifier", ("hypodense",)),
    ],
    [
        Cue("cannot_exclude", "priority_uncertain", ("cannot be excluded",), "backward"), Cue("not_evaluated", "technical", ("could not be evaluated",), "both"), Cue("no_change", "pseudo_negation", ("no significant change",), "both"),
        Cue("no", "negation", ("no", "not"), "forward"), Cue("non", "negation", ("non-",), "attached"), Cue("possible", "uncertain", ("possible",), "forward"), Cue("previous", "prior", ("previously",), "forward"), Cue("grew", "change", ("increased",), "both", "increased", True),
    ],
    ["but", ";"], {"right": "right", "left": "left", "both": "bilateral"},
)
ENGINE = Engine(LEXICON)


def by(sentence):
    return {m["concept"]: m for m in ENGINE.annotate(sentence)}


def test_hard_sentences():
    assert len(segment.sentences("Metastatic breast Ca  Findings compatible with Covid pneumonia  Bilateral supraclavicular lymph nodes")) == 3
    assert len(segment.sentences("1.5 mm thick sections were taken in the axial plane. Trachea is open.")) == 2
    found = segment.sentences("Seen in both regions.3.2021. There is an area of atelectasis.")
    assert found[-1][0].startswith("There is an area")
    text = "  A b.  C d! \n· e"
    assert all(text[a:b] == x for x, a, b in segment.sentences(text))
    assert "".join(segment.lossless("One. Two!  Üç? dört")) == "One. Two!  Üç? dört"
    assert segment.sentences(None) == segment.sentences("...") == []


def test_measurements():
    raw = lambda t: [m["raw_text"] for m in measure.measurements(t)]
    assert raw("A 12.5 mm nodule.") == ["12.5 mm"] and raw("examination limits.5 mm in diameter") == ["5 mm"] and raw("CT dated 7.12.2021") == []
    first = lambda t: measure.measurements(t)[0]
    assert first("5x3 mm")["axes_mm"] == [5, 3] and first("26x18x40 mm")["axes_mm"] == [26, 18, 40] and first("1.5 cm")["axes_mm"] == [15]
    assert first("2-3 mm")["axes_mm"] == [2, 3] and first("2-3 mm")["is_range"]
    assert first("section thickness of 5 mm")["is_technical"] and not first("50 mm at its thickest point")["is_technical"]
    assert first("submilimetric nodule")["size_qualitative"] == "submillimetric"
    assert measure.largest_mm("3 mm and 2 cm") == 20 and measure.tolerant_match([1, 9], [10.5]) and not measure.tolerant_match([], [1])


def test_matcher():
    assert [m.concept for m in ENGINE.mentions("space-occupying lesion")] == ["lesion"]
    assert [m.concept for m in ENGINE.mentions("nodule nodule-nodules, nodule")] == ["nodule", "nodule"]
    assert longest("thoracic aorta") == 14 and longest("a{2}b?") == 3 and has_capture("(a)") and not has_capture("(?:a)")
    with pytest.raises(ValueError):
        union_matcher([Concept("x", "observation", ("(a)",))])


def test_side():
    assert by("both lungs are clear")["lung"]["laterality"] == "bilateral"
    assert by("right " + "x" * 70 + " lung")["lung"]["laterality"] is None
    assert by("left lung right")["lung"]["laterality"] == "left"


def test_assertion_and_time():
    assert by("infiltration cannot be excluded.")["infiltration"]["assertion"] == "uncertain"
    assert {m["assertion"] for m in by("No pleural effusion or thickening").values()} == {"absent"}
    x = by("non-calcified nodule")
    assert x["calcific"]["assertion"] == "absent" and x["nodule"]["assertion"] == "present"
    assert by("The heart could not be evaluated optimally.")["heart"]["assertion"] == "present"
    assert by("No effusion but nodule")["nodule"]["assertion"] == "present"
    assert by("previously nodule")["nodule"]["temporality"] == "prior" and by("nodule increased compared to the former examination")["nodule"]["change_type"] == "increased"
    assert by("nodule increased")["nodule"]["change_type"] == "none" and by("nodule no significant change")["nodule"]["change_type"] == "stable"


def relations(sentence):
    found = ENGINE.mentions(sentence)
    edges, open_ = ENGINE.relations(sentence, found, measure.measurements(sentence))
    name = lambda i: found[i].concept if i >= 0 else "measure"
    return {(e["relation"], name(e["head"]), name(e["tail"])) for e in edges}, {(o["relation"], o["reason"]) for o in open_}


def test_relations():
    edges, open_ = relations("lung, nodule, liver")
    assert not any(e[0] == "located_at" for e in edges) and ("located_at", "tie") in open_
    edges, _ = relations("A 13 mm hypodense lesion in the liver.")
    assert ("measured_by", "lesion", "measure") in edges and ("modify", "hypodense", "lesion") in edges and ("located_at", "lesion", "liver") in edges
    assert ("measured_by", "aorta", "measure") in relations("Thoracic aorta diameter is 34 mm.")[0]


def test_sections():
    found = sections.sections("intro\n# Lungs:\na\n**Note** b\n**heart**: c\n# Lungs\nd", {"heart"})
    assert found == [("", "intro"), ("Lungs:", "a\n**Note** b"), ("heart", "c"), ("Lungs", "d")]
    assert sections.normal_heading(" **2.1 Chest CT  Lungs:** ", {"lungs"}, ("chest ct ",)) == "lungs"
    assert sections.bucket("x", {"a": "b"}, {"b"}) == ("unknown", False, True) and sections.bucket("a", {"a": "b"}, {"b"}) == ("b", True, False)


def test_sentence_rows_match_offsets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["txt_sentences"](spark, sf)
    assert rows.count() > 1000 and segment.offset_errors(rows, docs, "doc_id", "text").count() == 0
    assert QUERIES["txt_mentions"](spark, sf).where("concept is null").count() == 0


def test_sentences_of_every_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in QUERIES["txt_sentences"](spark, sf).select("doc_id").distinct().collect()}
    assert got == {r.doc_id for r in docs.collect() if segment.sentences(r.text)}
    assert {"de", "en", "es", "fr"} <= {r.lang for r in docs.collect() if r.doc_id in got}


def test_exposure_at_edges_of_words_and_lines(spark, tmp_path):
    passage = "bar baz qux quux corge grault garply waldo fred plugh xyzzy thud and more"
    texts = ["foo\n" + passage, "a\tb\n\n" + passage, "x" + passage, "few words", "not " + passage[10:], passage.replace(" ", "\n"), None]
    spark.createDataFrame([(i, x, f"s{i}") for i, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "Few words"), (3, "nowhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in QUERIES["txt_exposure"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 3), (2, 1, 1)}
