"""Personal data and secrets against plain Python, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codefacts.llm import catalog, pii, secrets

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}
            if fine[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def noisy(seed):
    rng = random.Random(seed)
    bits = ["a@b.c", "x.y@mail-1.example.com", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.256", "1.2.3.4.5.6.7.8", "+1 (415) 555-0199", "+49 30 1234567", "++1-", "é😀", "word", " ", "\n", "@", "%d@e.f",
            "00004111111111111111", "255.255.255.255", "a.@b", "3.1.4", "name [at] host [dot] com", "415-555-0199", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    return "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def noise(spark):
    rows = [(i, noisy(i)) for i in range(400)] + [(1000, None), (1001, ""), (1002, "9" * 40_000), (1003, "a" * 60_000 + "@b.c" * 2_000), (1004, "1.2.3.4 " * 6_000), (None, "a@b.co"), (1, noisy(1))]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_text", F.lit("x")).withColumn("size", F.lit(1)).repartition(8)


def test_base_spans_equal_plain_patterns(noise):
    for r in noise.join(pii.personal_data(noise).withColumn("doc_id", F.col("doc_id")), "doc_id").select("text", "base", "spans").collect():
        got = [f"{pii.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["base"]]
        assert got == base_spans(r["text"] or "")
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    assert pii.personal_data(noise).count() == noise.count()


def test_digest_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in catalog.op1_pii(spark, folder).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r["n_card"] == sum(s.startswith("card") for s in want)


def test_redaction_keeps_rows_and_columns(noise):
    out = pii.redacted(noise.withColumn("n_chars", F.lit(-1).cast("bigint")))
    assert out.columns == [*noise.columns, "n_chars"] and out.count() == noise.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1000]["text"] is None and rows[1001]["text"] == "" and rows[None]["text"] == "<EMAIL>"
    assert rows[1004]["text"] == "<IP> " * 6_000 and rows[1004]["n_chars"] == len("<IP> ") * 6_000
    for r in rows.values():
        assert not re.search(PATTERNS["email"], r["text"] or "")


def test_written_out_addresses_are_learned(spark):
    rows = [(i, f"Please contact us by mail: info{i} [at] example [dot] com or a{i}@example.org today") for i in range(40)] + [(100 + i, f"order 415-555-{1000 + i} of version 1.2.{i}") for i in range(5)]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(len(r["spans"]) == 2 for r in found if r["doc_id"] < 100)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.personal_data(empty).count() == 0 and pii.redacted(empty).count() == 0 and secrets.secrets(empty).count() == 0


def test_secrets_equal_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["token = \"24be64439e3e49cf46b2d7c90f3602a3\"", "API_KEY:abcdefghijkl", "api_key= short", "PassWord='x'", "AKIA" + "A1" * 8, "AKIAAB", "deadbeefdeadbeef", "abc", " ", "\n", "é", "secrettoken: 123456789012", "passwd   =   0123456789ab.-_", "ſecret=abcdefghijklmno"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(40)))) for i in range(300)] + [(900, None), (901, ""), (902, "token" + " " * 50_000), (903, "f" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("clash"))
    base = {0: (r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12), 1: (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), 2: (r"[0-9a-f]+", lambda m: len(m[0]) >= 16)}
    texts = dict(rows)
    for r in secrets.secrets(docs).collect():
        want = sorted((m.start(), k, m.end()) for k, (p, keep) in base.items() for m in re.finditer(p, texts[r["doc_id"]] or "") if keep(m))
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] == want


def brute_cost(value):
    """The same prices over all cuts, without the shortcuts."""
    from functools import cache

    @cache
    def best(i):
        if i == 0:
            return 0.0
        return min(best(j) + price(j, i) for j in range(i))

    def price(j, i):
        piece, low = value[j:i], value[j:i].lower()
        out = [secrets._size(piece)] if i - j == 1 else [float("inf")]
        if i - j >= 3 and all((a, b) in secrets.NEXT for a, b in zip(low, low[1:])):
            out.append(secrets.math.log10(40 * (i - j)))
        if i - j >= 2 and low in secrets.RANKS and piece == low:
            out.append(secrets.math.log10(secrets.RANKS[low] + 1))
        return min(out)

    return best(len(value))


def test_guess_cost():
    for v in ["password", "qwertypassword", "xkzvq", "lovemonkey", "asdfgh"]:
        assert abs(secrets.guess_cost(v) - brute_cost(v)) < 1e-9
    weak = ["changeme123", "qwerty2020", "aaaaaaaaaaaa", "P@ssw0rd!", "20230114", "abcabcabcabc", ""]
    strong = ["hX9$kq2!Lm", "f33e61083db5dbdf", "vT7pQz93LkwM"]
    assert max(map(secrets.guess_cost, weak)) < secrets.LEAST_GUESSES < min(map(secrets.guess_cost, strong))
    assert secrets.guess_cost("x9" * 20_000) < 10


def test_context_values():
    kinds = lambda t: [s[1] for s in secrets.find_secrets(t)]
    assert kinds("pwd: hX9$kq2!Lm and more") == [3] and kinds("pwd: changeme123") == [] and kinds("the compass is turning") == []


def test_values_of_one_character_class_are_costed(spark):
    strong = ["pwd: zqxvkjwpmtrhgbfy", "passphrase = QZXVKJWPMTRHGB", "auth: 83920174658291", "password: kqzvwxyjpt"]
    weak = ["pwd: unbelievable", "passphrase = harvestmeadow", "auth: 12345678", "the password is unbelievable", "pwd: qwertyuiop"]
    prose = ["An unbelievable harvest.", "The meadow was unbelievable after the harvest.", "A meadow."]
    docs = spark.createDataFrame(list(enumerate(strong * 2 + weak + prose)), "doc_id bigint, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.secrets(docs).collect()}
    assert all(3 in got[i] or 0 in got[i] for i in range(8)), got
    assert not any(got[i] for i in range(8, len(got))), got
