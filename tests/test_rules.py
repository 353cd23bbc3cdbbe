"""Rules that SQL doesn't see: errors, null keys, empty tables, hand-made cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import contracts, findings, gates, joins, packaging, ranks, resample, sampling, studies, vectors
from skein.plans import findings as plans
from skein.sources import read_csv, rewrite, sheets, write_csv, write_records, write_text_once, write_unannotated
from skein.text import measure, sections, surface
from skein.text.evidence import Collector, EvidenceLexicon
from skein.text.exposure import exposure

ENT = "study long, section string, sent_idx int, entity_id long, kind string, concept string, raw_text string, text string, char_start int, char_end int, assertion string, rule string, cue string, change string, f string"


def entities(spark, *rows):
    base = {"study": 1, "section": "findings", "sent_idx": 0, "entity_id": 0, "kind": "observation", "concept": "nodule", "raw_text": "nodule", "text": "a nodule", "char_start": 2, "char_end": 8, "assertion": "present", "rule": "default", "cue": None, "change": "none", "f": "N"}
    return spark.createDataFrame([tuple((base | {"entity_id": i} | r).values()) for i, r in enumerate(rows)], ENT)


def rels(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "study long, head_id long, tail_id long, relation_type string, tail_text string, seq long")


def test_sentence_keys_have_their_section(spark):
    ent = entities(spark, {"concept": "scar"}, {"section": "impression", "concept": "scar", "assertion": "absent"}, {"section": None, "text": "possibly benign"})
    got = findings.definite_benign(ent, ["scar"], ["default"], "possibly benign").collect()
    assert {tuple(r) for r in got} == {(1, "findings", 0), (1, None, 0)}


def test_modifiers_regions_and_sizes(spark):
    ent = entities(spark, {}, {"concept": "spiculated", "kind": "qualifier"}, {"concept": "liver", "kind": "anatomy"}, {"raw_text": "nodules", "text": "biopsy of the liver lesions and pulmonary nodules", "char_start": 41, "char_end": 48}, {"sent_idx": 1})
    rel = rels(spark, (1, 0, "modify", None, 0), (0, 1, "modify", None, 0), (4, 2, "located_at", None, 0), (3, 2, "located_at", None, 0), (0, 9, "measured_by", "1,5 cm", 1), (0, 9, "measured_by", "7 mm", 2))
    assert {r.entity_id: r.suspicious for r in findings.with_modifier(ent, rel, ["spiculated"]).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert [r.entity_id for r in findings.outside_region(ent, rel, ["liver"], ["lung"], "pulmonar|lung").collect()] == [4]
    both = ent.union(entities(spark, {"sent_idx": 1, "concept": "lung", "kind": "anatomy"}, {"sent_idx": 1, "concept": "liver", "kind": "anatomy"}))
    assert findings.outside_region(both, rel, ["liver"], ["lung"], "pulmonar|lung").count() == 0
    assert {r.entity_id: r.size_mm for r in findings.with_size(ent, rel).collect()}[0] == 7.0
    for f in (lambda: findings.with_size(ent, None), lambda: findings.with_modifier(ent, None, []), lambda: findings.require(ent, ["in_stock"])):
        with pytest.raises(ValueError):
            f()


def test_lobes_and_sizes(spark):
    df = spark.createDataFrame([("left middle lobe", "2,5cm"), ("Lower lobe of the right lung", "12 MM"), ("upper lobe", "big"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(findings.lobe(F.col("a")), findings.size_mm(F.col("b"))).collect()] == [("LUL", 25.0), ("RLL", 12.0), (None, None), (None, None)]


def test_empty_tables_have_defined_results(spark):
    ent, rel = entities(spark, {}).limit(0), rels(spark, (1, 0, "modify", None, 0)).limit(0)
    assert findings.promoted(ent).count() == findings.anatomy_context(ent, rel).count() == findings.with_size(ent, rel).count() == 0
    series = spark.createDataFrame([(5, False)], "study long, placeholder boolean")
    x = findings.with_size(ent, rel).withColumns({"in_scope": F.lit(True), "bucket": F.lit("thorax"), "is_outside": F.lit(False)})
    levels = spark.createDataFrame([], "study long, level string, source string")
    (r,) = findings.summary(x, series, levels, ["nodule"], ["scar"], ["mass"], "solid").collect()
    assert (r.nodule, r.lobes, r.level, r.qf_no_section) == ("not_assessable", [], "not_mentioned", True)
    rows = {r.rule: r.violations for r in gates.invariants(ent.withColumn("covered", F.lit(True)), ent.select(*findings.SENTENCE).withColumns({c: F.lit(True) for c in ("technical", "negated", "coordinated", "backward_only")}), findings.SENTENCE).collect()}
    assert rows == {f"K{k}": 0 for k in range(11, 16)}
    assert not gates.share_within(ent, "kind", "x", 0, 1).first().accepted and not gates.early_stop(ent, F.lit(True), ["entity_id"]).first().stop
    assert ranks.running(ent.select("study"), "study", {"n": F.lit(1)}).count() == 0 and ranks.quantiles(ent, "study", {"m": 0.5}).collect()[0].m is None


def test_running_sums_against_plain_python(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 1.0, 1.0, 2.5, float(rng.randint(0, 9))]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    for descending in (False, True):
        got = {r.i: r.n for r in ranks.running(df, "v", {"n": F.lit(1)}, ["g"], ["i"], descending).collect()}
        for g in "ab":
            key = lambda r: ((r[1] is None) if descending else (r[1] is not None), (-1 if descending else 1) * (r[1] or 0), r[2])
            for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=key)):
                assert got[r[2]] == n
    loose = {r.i: r.n for r in ranks.running(df, "v", {"n": F.lit(1)}, ["g"]).collect()}
    assert all(loose[i] == sum(1 for h, w, _ in rows if h == g and v is not None and (w is None or w < v)) for g, v, i in rows if v is not None)
    assert ranks.average_rank(df.where("v is not null"), "v").where("v = 1.0").select("rank").distinct().count() == 1


def test_undefined_iterations(spark):
    draws = spark.createDataFrame([(float(i),) for i in range(90)] + [(None,)] * 10, "d double")
    r = resample.interval(draws, "d").first()
    assert (r.defined, r.undefined, r.trusted, r.low) == (90, 10, False, None)
    with pytest.raises(Exception, match="undefined"):
        resample.interval(draws, "d", strict=True).collect()
    assert resample.interval(draws.where("d is not null"), "d").first().trusted and not resample.interval(draws.limit(0), "d").first().trusted


def test_bootstrap_and_permutation_behave(spark):
    df = spark.createDataFrame([(i, i % 10, float(i % 10 * 3 + i % 7), int(i % 10 > 6)) for i in range(200)], "i long, c long, s double, y int")
    p = resample.permutation_p(resample.permuted_auc(df, "i", "s", "y", 60)).first()
    assert p.observed > 0.95 and p.p == pytest.approx(2 / 61) and 0.4 < p.median < 0.6
    diff = resample.interval(resample.group_difference(df, "i", F.col("c") > 4, F.col("y") == 1, 300), "diff").first()
    assert diff.low < 60 < diff.high and diff.mean == pytest.approx(60, abs=4)


def test_pilot_is_plain_greedy_choice(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), i, rng.choice("aaabbc")) for i in range(80)]
    df = spark.createDataFrame(rows, "d long, s long, l string")
    quotas, most = {"a": 6, "b": 5, "c": 3}, 2
    import hashlib

    rank = lambda r: hashlib.sha1(f"7|{r[2]}|{r[0]}|{r[1]}".encode()).hexdigest()
    load, want = {}, []
    for name in sorted(quotas, key=lambda k: (sum(r[2] == k for r in rows), k)):
        left = [r for r in rows if r[2] == name]
        for _ in range(quotas[name]):
            best = min((r for r in left if load.get(r[0], 0) < most), key=lambda r: (load.get(r[0], 0), rank(r)))
            left.remove(best)
            load[best[0]] = load.get(best[0], 0) + 1
            want.append(best)
    assert sorted(map(tuple, sampling.pilot(df, "d", "s", "l", quotas, most, 7).collect())) == sorted(want)
    with pytest.raises(ValueError):
        sampling.pilot(df, "d", "s", "l", {"c": 60}, 1, 7)
    with pytest.raises(PermissionError):
        sampling.require_open("held_out")
    assert sampling.require_open("dev") == "dev"


def test_joins(spark):
    rng = random.Random(3)
    a, b = [("g", i, rng.randint(0, 30)) for i in range(40)], [("g", i, rng.randint(0, 30)) for i in range(15)]
    got = {r.id: (r.gap, r.t_id) for r in joins.first_nearest(spark.createDataFrame(a, "g string, id long, at long"), spark.createDataFrame(b, "g string, t_id long, t_at long"), ["g"]).collect()}
    assert got == {i: min((abs(x - y), j) for _, j, y in b) for _, i, x in a}
    one = spark.createDataFrame([(1,), (2,)], "k long")
    joins.require_equal_sets(one, one.union(one), ["k"], "t")
    with pytest.raises(ValueError):
        joins.require_equal_sets(one, one.where("k = 1"), ["k"], "t")
    with pytest.raises(ValueError):
        joins.renamed(one, {"x": "y"})
    assert [tuple(r) for r in joins.first_rows(spark.createDataFrame([(None, 2, "b"), (None, 1, "a")], "k long, o long, v string"), ["k"], ["o"]).collect()] == [(None, 1, "a")]


@pytest.mark.parametrize("right, limit", [(True, None), (False, None), (True, 4), (False, 3)])
def test_nearest_spans_against_all_pairs(spark, right, limit):
    rng = random.Random(11)
    span = lambda: (lambda s: (s, s + rng.randint(0, 5)))(rng.randint(0, 60))
    a, b = [(g, i, *span()) for g in ("x", None, "y") for i in range(25)], [(g, 100 + i, *span()) for g in ("x", None) for i in range(12)]
    a.append(("x", 3, *span()))  # a second span of one id
    got = joins.nearest(spark.createDataFrame([*a, ("x", 90, None, 3)], "g string, id long, s long, e long"), spark.createDataFrame([*b, ("x", 91, 1, None)], "g string, t_id long, t_s long, t_e long"), ["g"], right, limit)
    want = {}
    for g, i, s, e in a:
        for h, j, ts, te in b:
            gap = max(0, ts - e, s - te)
            if g == h and (limit is None or gap <= limit):
                want.setdefault((g, i), []).append(((gap, 0 if ts >= s or not right else 1), j))
    best = {k: (min(v)[0], [j for p, j in v if p == min(v)[0]]) for k, v in want.items()}
    assert {(r.g, r.id): (r.gap, r.t_id, r.tie) for r in got.collect()} == {k: (p[0], js[0] if len(js) == 1 else None, len(js) > 1) for k, (p, js) in best.items()}


def test_contracts():
    inventory = {"a", "b"}
    ok = '{"findings": [{"concept_id": "a", "assertion": "absent"}]}'
    assert contracts.parse_output(ok, inventory) == ([("a", "absent")], None)
    for raw, error in (('{"findings": [{"concept_id": ["a"], "assertion": "absent"}]}', "inventory"), ('{"findings": [{"concept_id": "a", "assertion": {}}]}', "assertion"), ("[" * 100_000, "not_json"), (None, "not_json")):
        assert contracts.parse_output(raw, inventory)[1] == error


def test_adapters(spark):
    class Upper:
        name = "upper"

        def run(self, texts):
            return [t.upper() for t in texts]

    class Swapped:
        name = "swapped"

        def run_named(self, pairs):
            return [(k, t) for k, t in reversed(pairs)]

    assert contracts.BySentence(Upper()).run(["One. Two!  three", "", None]) == ["ONE. TWO!  THREE", "", ""]
    df = spark.createDataFrame([(1, "5 mm nodule"), (2, "a scar")], "k long, t string").coalesce(1)
    rows = {r.k: r for r in contracts.post_edited(df, "k", "t", Upper(), "prompt").collect()}
    assert rows[1]["class"] == "clean" and not rows[1].broken
    with pytest.raises(Exception, match="another order"):
        contracts.apply_adapter(df, "k", "t", Swapped()).collect()


def test_measurements_of_any_shape():
    m = lambda t: [(x["raw_text"], x["axes_mm"], x["is_range"]) for x in measure.measurements(t)]
    assert m("5x4x3x2 mm") == [("5x4x3x2 mm", [5, 4, 3, 2], False)] and m("3 × 1,5 cm and 2 - 3mm") == [("3 × 1,5 cm", [30, 15], False), ("2 - 3mm", [2, 3], True)]
    assert m("5 mm2, 7.12.2021 mm, 12 xmm, A5 cm") == [] and m("4 cm 5 mm") == [("4 cm", [40], False), ("5 mm", [5], False)]
    t = lambda s: measure.measurements(s)[0]["is_technical"]
    assert t("5 mm sections were taken") and t("collimated at 5 mm") and t("tube current 100 mAs; reconstructed at 5 mm") and t("slice interval 2 mm")
    assert not t("50 mm at its thickest point") and not t("a mass of 5 mm in the section") and not t("nodule of 3 mm taken as benign")
    assert measure.measurements(None) == [] and len(measure.measurements("1 mm " * 5000)) == 5000


def test_sections_and_scope():
    known = {"lungs", "heart"}
    assert sections.sections("- **Lungs:** clear\n## Heart ##\nnormal\n**Other:** x", known) == [("Lungs:", "clear"), ("Heart", "normal\n**Other:** x")]
    assert sections.scoped_text("# Lungs\na\n# Heart\nb", known, {"heart"}) == "a" and sections.scoped_text("plain", known, {"heart"}) == "plain" and sections.scoped_text(None, known, set()) == ""


def test_evidence_and_axes(spark):
    lexicon = EvidenceLexicon({"nodule": "nodules?", "malignancy": "tumou?r"}, {"lung": "lungs?", "liver": "liver"}, {"history": "history"}, r"\bno\b", r"\bbut\b", "calcified", "possible", "suspicious", "metasta")
    c = Collector(lexicon)
    assert c.collect(None) == [] and c.region("lung tumour liver", 5) == "lung"
    (x,) = c.collect("no" + " x" * 70 + " nodule in the lung")
    assert not x["negated"] and x["region"] == "lung"
    df = spark.createDataFrame([(1, "nodule", "lung", "current", False, False, False, True), (2, "malignancy", "lung", "history", False, False, False, False), (3, "malignancy", "liver", "current", False, False, False, False), (4, "nodule", "lung", "current", True, False, False, False), (5, "malignancy", "lung", "follow_up", False, True, False, False)], "study long, kind string, region string, time string, negated boolean, hedged boolean, suspicious boolean, benign boolean")
    assert {r.study: r.axis_a for r in findings.axes(df, ["lung"]).collect()} == {1: "low", 2: "known_malignancy", 3: "not_mentioned", 4: "none", 5: "intermediate"}


def test_text_rules(spark):
    df = spark.createDataFrame([("No nodule or mass. Lungs clear", 3, 9), ("nodule: none seen", 0, 6), ("no scar, but a nodule", 15, 21), (None, 0, 1)], "t string, s int, e int")
    present = [r[0] for r in df.select(surface.finding_present(F.col("t"), "nodule", r"\bno\b", r"\bbut\b", r"\W*none")).collect()]
    assert present == [False, False, True, False]
    assert df.select(surface.around(F.col("t"), F.col("s"), F.col("e"))).first()[0] == "No nodule or mass"
    one = spark.createDataFrame([("size 2.0", "Çok  İyi", "a; b,,c|d")], "a string, b string, c string").select(surface.split_after(F.col("a"), "."), surface.free_list(F.col("c")), surface.folded(F.lit("Çédille  Ñ"))).first()
    assert tuple(one) == (["size 2.0"], ["a", "b", "c", "d"], "cedille n")
    grams = spark.createDataFrame([("The scar of the lung",)], "t string").select(surface.ngrams(F.col("t"), ["the", "of"])).first()[0]
    assert set(grams) == {"scar", "lung", "the scar", "scar of", "the lung", "the scar of", "scar of the", "of the lung"} - {"of the lung"}


def test_exposure_finds_whole_texts_anywhere(spark, monkeypatch):
    from skein.text import exposure as module

    monkeypatch.setattr(module, "ITEMS", 2)
    docs = spark.createDataFrame([(1, "s", "x\nFoo bar baz\ny"), (2, "s", "foo bar"), (3, None, None), (4, "t", "unfoo bar bazzz foo bar baz")], "doc_id long, source string, text string")
    items = spark.createDataFrame([(1, "foo BAR baz"), (2, "foo bar"), (3, ""), (4, None), (5, "foo bar baz")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in exposure(docs, items, "item_id", "text").collect())
    assert got == [(1, 1), (1, 2), (1, 5), (2, 2), (4, 1), (4, 2), (4, 5)]
    assert exposure(docs.limit(0), items, "item_id", "text").count() == 0 == exposure(docs, items.limit(0), "item_id", "text").count()


def test_vectors_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(40)] + [(40, [1.0, 0.0, 0.0, 0.0], 0), (41, [2.0, 0.0, 0.0, 0.0], 1), (42, None, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y long").repartition(4)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), 9)
    known = [r for r in rows if r[1]]
    want = {}
    for i, v, y in known[::5]:
        order = sorted((-cos(v, w), j) for j, w, _ in known if j != i)
        want[i] = next(n for n, (_, j) in enumerate(order, 1) if rows[j][2] == y)
    got = vectors.first_hit_ranks(df, "id", "v", "y", F.col("id") % 5 == 0)
    assert {r.id: r["rank"] for r in got.collect()} == want
    assert tuple(vectors.near_copies(df, "id", "v", F.col("id") >= 40).first()) == (2, 2)


def test_sources(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    rewrite(spark, at, lambda df: df.withColumn("x", F.lit(1)))
    assert spark.read.parquet(at).columns == ["id", "x"] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.backup")  # as a crash between the moves leaves it
    rewrite(spark, at, lambda df: df.where("id > 0"))
    assert spark.read.parquet(at).count() == 2
    form = spark.createDataFrame([(1, None), (2, None)], "k long, answer string")
    write_csv(form, str(tmp_path / "m"), mark=True)
    assert next((tmp_path / "m").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfk,") and read_csv(spark, str(tmp_path / "m")).columns == ["k", "answer"]
    write_unannotated(form, str(tmp_path / "f"), ["answer"])
    write_unannotated(form.withColumn("answer", F.lit("yes")), str(tmp_path / "f"), ["answer"])
    with pytest.raises(FileExistsError):
        write_unannotated(form, str(tmp_path / "f"), ["answer"])
    write_text_once(spark, str(tmp_path / "n.json"), "ü")
    assert (tmp_path / "n.json").read_text() == "ü"
    with pytest.raises(FileExistsError):
        write_text_once(spark, str(tmp_path / "n.json"), "x")
    write_records(form, str(tmp_path / "r"))
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("*.json")).count('"answer":null') == 2


def test_sheets(spark, tmp_path):
    at = str(tmp_path / "b.xlsx")
    a = spark.createDataFrame([(1, 2.5, "x & <y>", None), (2, None, "", True)], "k long, v double, t string, b boolean")
    sheets.write_sheets({"one": a, "two & more": a.select("k")}, at)
    assert sheets.sheet_names(at) == ["one", "two & more"]
    got = sheets.read_sheet(spark, at, "one", ["k", "t"], {"k": "long"})
    assert [tuple(r) for r in got.collect()] == [(1, "x & <y>"), (2, "")] and sheets.read_sheet(spark, at, 1).count() == 2
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, at, "three")
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, at, 0, ["nothing"])


def test_packages(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(9)], "k long, t string, y long")
    manifest = packaging.write_package(df, "k", ["t"], ["y"], "s", str(tmp_path), {"about": "x"})
    visible = spark.read.json(str(tmp_path / "visible")).select("case_id", "t")
    packaging.check_package(visible, manifest["visible"], "visible")
    with pytest.raises(ValueError):
        packaging.check_package(visible.limit(8), manifest["visible"], "visible")
    x = packaging.verify_lock(df, "y", "k", {"0": "0"}).withColumn("y", F.col("y").cast("string"))
    assert {r.y: r.state for r in x.collect()} == {"0": "differs", "1": "missing"}
    held = {str(r.y): r.sha256 for r in packaging.fingerprint(df, "k", ("y",)).collect()}
    assert {r.state for r in packaging.verify_lock(df, "y", "k", held).collect()} == {"holds"}


def test_annotations_are_locked_once(spark, tmp_path):
    blind = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    done = blind.withColumn("answer", F.lit("x"))
    with pytest.raises(gates.GateError, match="missing"):
        packaging.lock_annotations(done.limit(1), blind, ["k"], ["t"], "a", str(tmp_path))
    with pytest.raises(gates.GateError, match="changed"):
        packaging.lock_annotations(done.withColumn("t", F.lit("z")), blind, ["k"], ["t"], "a", str(tmp_path))
    assert packaging.lock_annotations(done, blind, ["k"], ["t"], "a", str(tmp_path))["annotations"]["n"] == 2
    with pytest.raises(Exception, match="already exists"):
        packaging.lock_annotations(done, blind, ["k"], ["t"], "a", str(tmp_path))


def test_verdicts(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.9,), (0.1,)], "v double")
    assert [r[0] for r in df.select(studies.verdict(F.col("v"), F.lit(0.5))).collect()] == ["not_measured", "not_measured", "passed", "failed"]
    empty = spark.createDataFrame([], "is_distractor boolean, a string")
    assert tuple(studies.distractor_audit(empty, ["a"]).first()) == (0, 0, None)


def test_shared_folder_needs_a_name_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from skein import session

    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.shared_folder(fake, "t")


def test_tidy_removes_what_the_application_wrote(spark):
    import os

    from skein import session

    at = session.settled(spark.range(3), "t").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(at) and spark.sparkContext.applicationId in at
    session.tidy(spark)
    assert not os.path.exists(at)


def test_hadoop_names_of_stores(monkeypatch):
    from skein import shared

    monkeypatch.setattr(shared.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda u: (None, u))}))
    assert shared.file_system("s3a://b/k")[1] == "s3://b/k" and shared.file_system("file:///a")[1] == "file:///a"


def test_derived_entities_meet_every_rule(spark, sf):
    ent = plans._ent(spark, sf)
    assert ent.count() == ent.select("entity_id").distinct().count() and {r[0] for r in ent.select("kind").distinct().collect()} == {"observation", "anatomy", "qualifier"}
