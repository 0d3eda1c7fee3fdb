"""Host rules, URL lists and mixing on small tables."""

import datetime
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from codefacts.llm import host_rules, mixing, url_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if runs[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "é😀", "# ", "$|", " ", "\n", "\t", " ", "x y z\n", " c "]) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += [None, "", "w " * 30_000, "\n\n\n", "a b c\n" * 5_000, "one two"]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").withColumn("_words", F.lit(1)).withColumn("n_words", F.lit("clash"))
    for r in host_rules.host_quality(docs).collect():
        want = rules(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_host_verdicts(spark):
    clean, poor = " ".join(f"word{i}" for i in range(80)), "too short"
    rows = [(i, clean if i % 30 == 0 else poor, "bad.example") for i in range(600)] + [(1000 + i, poor if i % 10 == 0 else clean, f"h{i % 7}.example") for i in range(700)] + [(5000, clean, None), (5001, clean, "once.example"), (5001, clean, "once.example")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"] for r in host_rules.host_quality(docs).where("kept").collect()}
    assert kept == {i for i, t, s in rows if t == clean and s != "bad.example"}
    assert host_rules.host_quality(docs.where("false")).count() == 0


def test_temporal_lists(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [("a.com", "s", "block", day(10)), ("a.com", "s", "allow", day(20)), ("a.com", "s", "block", day(20)), ("a.com", "s", "allow", day(30)), ("x.a.com", "t", "allow", day(15)), ("A.com", "s", "block", day(10)), (None, "s", "block", day(1)), ("b.com", None, "block", day(1))]
    captures = [(i, url, day(n) if n is not None else None) for i, (url, n) in enumerate([
        ("http://a.com/p", 9), ("http://a.com/p", 10), ("https://user@A.COM:80/p", 19), ("http://a.com", 20), ("http://a.com", 30), ("http://x.a.com/", 14), ("http://x.a.com/", 15), ("http://nota.com/", 12), (None, 12), ("http://a.com", None), ("", 12), ("no url", 12), ("http://b.com", 5)])]
    got = url_lists.judged(spark.createDataFrame(captures + [captures[1]], "page_id bigint, url string, day date").withColumn("rule", F.lit("clash")), spark.createDataFrame(entries, "rule string, list string, action string, day date"))
    assert sorted(r["page_id"] for r in got.where("blocked").collect()) == [1, 1, 2, 3, 5]
    assert {r["page_id"]: r["rule"] for r in got.collect()}[6] == "x.a.com" and got.count() == len(captures) + 1


def expected_targets(sizes, weights, most=3.0):
    total, target, stopped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        share = sum(w for i, w in enumerate(weights) if i not in stopped)
        target = [most * sizes[i] if i in stopped else left * weights[i] / share for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in stopped and target[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return target
        stopped |= over


def test_targets_and_copies(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for s, count in [("a", 300), ("b", 3), ("c", 1), ("d", 120), ("Z", 40), (None, 5), ("é", 60)]:
        for _ in range(count):
            rows.append((n, " ".join(["w"] * rng.randrange(1, 60)), s))
            n += 1
    rows += [(n, None, "a"), (n + 1, "", "b"), (3, rows[3][1], "a"), (None, "w w", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rate", F.lit("clash")).repartition(4)
    got = mixing.mixed(docs).collect()
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == name) for name in names]
    want = dict(zip(names, expected_targets(sizes, [i % 3 + 1 for i in range(len(names))])))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in names)
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(3)).collect()))
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns and mixture.count() == sum(r["copies"] if r["size"] else 1 for r in got)
    assert mixing.mixed(docs.where("false")).count() == 0 and mixing.mixture(docs.withColumn("size", F.lit(5))).where("size <> 5").count() == 0
