import hashlib
import re

from skein.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "a" * 70000, "9" * 3000, "1." * 1000, "+1 (017) 555-7713 und.34@mail7.example.com x@y z@q.c.@b.d a@b@c.de é@a.bc",
    "4417744280351547 4929 3483 8514 6306 97.51.17.173 1.2.3.256 001.2.3.4 1.2.3.4.5.6.7.8 +1((((((( +12-3",
    "IBAN GB82 WEST 1234 5698 7654 32 ssn 123-45-6789, device 00:1B:44:11:3A:B7", "order 123-45-6789", "𝒳 a.b@c.d 😀 10.0.0.1",
]


def test_spans_equal_the_plain_patterns():
    for t in TEXTS:
        assert [f"{x.kind}:{x.start}:{x.end}" for x in pii.find(t) if x.kind in pii.BASE_KINDS] == brute(t)


def test_validators_and_context():
    kinds = [(x.kind, x.score >= pii.THRESHOLD) for x in pii.find(TEXTS[7])]
    assert ("iban", True) in kinds and ("mac", True) in kinds
    assert ("ssn", True) in kinds and not pii.find(TEXTS[8])  # "order" speaks against, nothing for
    assert not pii.mod97("GB82WEST12345698765433")
    assert pii.redact("mail a@b.cd now", pii.find("mail a@b.cd now")) == "mail [EMAIL] now"


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in pii.op10_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        b = brute(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest()
        assert got[d.doc_id].n_card == sum(x.startswith("card") for x in b)


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a@b.cd", 3), (1, "a@b.cd", 3)], "doc_id long, text string, spans int")
    got = pii.digest_columns(pii.detect(df)).collect()
    assert sorted(r.n_email for r in got) == [0, 0, 1, 1]
    assert pii.detect(df.limit(0)).count() == 0


def test_addresses_of_letters_alone():
    for t in ("FF:FF:FF:FF:FF:FF", "adapter aa:bb:cc:dd:ee:ff"):
        (x,) = pii.find(t)
        assert x.kind == "mac" and t[x.start : x.end] == t.split()[-1] and pii.redact(t, [x]).endswith("[MAC]")


def test_context_words_count_whole():
    assert not pii.find("antisocial" + "z" * 40 + " 123-45-6789") and not pii.find("123-45-6789 " + "z" * 41 + "socialite")
    assert [x.kind for x in pii.find("social 123-45-6789")] == ["ssn"]
    t = "x" * 100 + " social " + "y" * (pii.WINDOW - 9) + " 123-45-6789"
    assert [x.kind for x in pii.find(t)] == ["ssn"]


def test_ibans_before_capital_words():
    t = "BE68 5390 0754 7034 IBAN GB82 WEST 1234 5698 7654 32 OK"
    assert [t[x.start : x.end] for x in pii.find(t) if x.kind == "iban"] == ["BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32"]


def test_secrets_need_a_word_that_says_so():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    for t, found in ((f'token = "{key}"', True), (f'TOKEN = "{key.upper()}" x', True), (f"commit {key}", False), ("token " + "a" * 40, False), ("token " + "a1" * 20, False)):
        assert [x.kind for x in pii.find(t)] == ["secret"] * found
    t = f'a token = "{key}" b'
    assert pii.redact(t, pii.find(t)) == 'a token = "[SECRET]" b'
