import re

import corpus_pipeline as cp
from skein.llm import quality, toxicity
from skein.session import table

from .test_jaccard import brute
from .test_packing import check_rows
from .test_pii import brute as plain_pii


def test_run_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    clean = docs.where(docs.doc_id.isin([r.doc_id for r in toxicity.locate(docs, model).where("score < 0.5").collect()]))
    good = [r for r in quality.score(clean, quality.train(clean, labels)).collect() if r.score >= 0.5]
    group = brute([(r.doc_id, r.text) for r in good])
    left = {}
    for r in good:
        if group[r.doc_id][1] == r.doc_id:
            text, shift = r.text, 0
            for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in plain_pii(r.text) + [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)])), key=lambda x: (x[1], -x[2])):
                if s + shift >= 0:
                    left.setdefault(r.doc_id, []).append((s, e, kind))
            spans, done, out = left.get(r.doc_id, []), 0, []
            for s, e, kind in spans:
                if s >= done:
                    out += [text[done:s], f"[{kind.upper()}]"]
                done = max(done, e)
            left[r.doc_id] = "".join(out) + text[done:]
    assert len(left) > 50
    check_rows(cp.run(spark, sf).collect(), left)


def test_stages_keep_columns_and_edge_rows(spark, sf):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "call +1 (017) 555-7713 now please ok", "en", "s", 36, 3), (2, "call +1 (017) 555-7713 now please ok", "en", "s", 36, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    long = spark.createDataFrame([(7, "word " * 60_000 + "a.b@c.de", "en", "s", 300_008, 0)], df.schema)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, long, sf).count() <= 1
        got = stage(spark, df, sf)
        assert got.columns == cp.COLUMNS
        assert stage(spark, df.limit(0), sf).count() == 0
    masked = cp.mask_personal_data(spark, df, sf).where("doc_id = 2").first()
    assert masked.text == "call [PHONE] now please ok" and masked.n_chars == len(masked.text)
    assert cp.mask_personal_data(spark, long, sf).first().text == "word " * 60_000 + "[EMAIL]"
    assert cp.drop_near_copies(spark, long, sf).count() == 1 and sum(r.length for r in cp.pack(spark, long, sf).collect()) > 60_000
    assert cp.drop_near_copies(spark, df, sf).count() == 3
    assert cp.pack(spark, df, sf).count() == 4
