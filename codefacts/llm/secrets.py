"""Secrets in text, with a guess-cost dynamic program for values in credential context.

Base patterns find assignments, access keys and hex runs. A wider context pattern finds further values that stand where a
credential stands; each is cut into words, dates, repeats, keyboard walks and brute-force spans at minimum cost, and is
reported when the cheapest cut still takes many guesses. Placeholders such as ``changeme123`` cost few guesses. The words are a
fixed list of common words of passwords and then the words of the texts themselves by count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.session import cut_lineage, drop_lineage

KINDS = ("assign", "access", "hex", "guess")
#: Values that need at least 10 to this power of guesses are secrets.
LEAST_GUESSES = 9.0
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"(?<![a-z0-9])(?:[a-z0-9]+[_-])?(?:pwd|pass|pw|passphrase|passcode|password|passwd|credentials?|auth|bearer|secret|token|(?:api|private|access|secret)[_-]?key)"
    r"(?:[\"']? *[:=]{1,2} *[\"']?| is [\"']?)([^\s\"'<>,;]{6,})", re.ASCII | re.IGNORECASE)

# Common words of passwords by rank.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou sunshine princess football "
    "baseball shadow superman trustno1 hello freedom whatever secret changeme default root test guest user pass "
    "example sample demo placeholder dummy your here none null true false token key value string enter insert "
    "replace me todo foo bar baz summer winter spring autumn monday friday january december love god sex "
    "money angel michael jordan charlie thomas daniel ashley jessica batman starwars computer internet "
    "server database oracle mysql postgres redis docker cloud system manager public private company office home "
    "account secure security access temp temporary the and for with this that not is it my new old"
).split()
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words of the texts that follow the fixed ones in rank, the rows a word must stand in, and the letters of the longest.
CORPUS_WORDS, LEAST_ROWS, LONGEST_WORD = 50_000, 2, 32
LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Counted words a worker holds before it hands them on.
HELD = 200_000
# Neighbours on a keyboard and in the alphabet.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm")
NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}
LEET = str.maketrans("430157$@", "aeoistsa")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/._]?[01]?[0-9][-/._]?[0-3]?[0-9]|[0-3]?[0-9][-/._]?[01]?[0-9][-/._]?(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}")


def _size(c: str) -> float:
    return math.log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 100)


def guess_cost(value: str, ranks: Mapping[str, int] = RANKS, longest: int = LONGEST_WORD) -> float:
    """Log10 of the guesses of the cheapest cut of ``value``; linear in its length. The empty value costs 0.

    ``ranks`` has the rank of each word in lower case, none longer than ``longest``.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    walk = same = 1
    again = [0] * 9
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if low[i] in "0123456789" and (m := DATE.match(low, i)):
            dates.setdefault(m.end(), []).append((i, 4.3 if m.end() - i > 4 else 2.1))
    for i in range(1, n + 1):
        cost = best[i - 1] + _size(value[i - 1])
        walk = walk + 1 if i > 1 and (low[i - 2], low[i - 1]) in NEXT else 1
        same = same + 1 if i > 1 and low[i - 2] == low[i - 1] else 1
        if walk >= 3:
            cost = min(cost, min(best[i - k] + math.log10(40 * k) for k in range(3, min(walk, 26) + 1)))
        if same >= 3:
            cost = min(cost, best[i - same] + math.log10(30 * same))
        for unit in range(2, 9):  # a unit that comes again and again costs what it costs once, and the count
            again[unit] = again[unit] + 1 if i > unit and low[i - 1] == low[i - 1 - unit] else 0
            if again[unit] >= unit:
                times = again[unit] // unit
                cost = min(cost, best[i - times * unit] + math.log10(times + 1))
        for start, price in dates.get(i, ()):
            cost = min(cost, best[start] + price)
        for k in range(2, min(longest, i) + 1):
            rank = ranks.get(low[i - k : i])
            leet = rank is None
            rank = ranks.get(plain[i - k : i]) if leet else rank
            if rank:
                piece = value[i - k : i]
                cased = not (piece.islower() or piece == piece.lower())
                cost = min(cost, best[i - k] + math.log10(rank + 1) + 0.5 * leet + (0.3 if piece[1:] == piece[1:].lower() else 1.0) * cased)
        best[i] = cost
    return best[n]


def find_secrets(text: str | None, ranks: Mapping[str, int] = RANKS) -> list[tuple[int, int, int, float]]:
    """(start, position in KINDS, end, log10 guesses) of all secrets in ``text``, by start and kind."""
    if not text:
        return []
    spans = []
    cost_of = lambda value: guess_cost(value, ranks)
    keyed = "=" in text or ":" in text
    if keyed:
        spans += [(m.start(), 0, m.end(), cost_of(m[1])) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), cost_of(m[0])) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    spans += [(m.start(), 2, m.end(), cost_of(m[0])) for m in HEX.finditer(text)]
    if keyed or " is " in text:
        taken = [(s, e) for s, _, e, _ in spans]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".!?)")
            end = m.start(1) + len(value)
            if len(value) >= 6 and not any(s < end and m.start() < e for s, e in taken):
                cost = cost_of(value)
                if cost >= LEAST_GUESSES:
                    spans.append((m.start(), 3, end, cost))
    return sorted(spans)


def words_in(text: str | None) -> set[str]:
    """The words of ``text`` in lower case, without those of values in credential context: a secret does not make itself a word."""
    if not text:
        return set()
    found = set(LETTERS.findall(text.lower()))
    for pattern in (ASSIGN, CONTEXT):
        for m in pattern.finditer(text) if "=" in text or ":" in text or " is " in text else ():
            found.difference_update(LETTERS.findall(m[1].lower()))
    return found


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter[str] = Counter()
    for frame in frames:
        for text in frame["text"]:
            held.update(words_in(text))
            if len(held) > HELD:
                yield pd.DataFrame(held.items(), columns=["word", "n"])
                held.clear()
    yield pd.DataFrame(held.items(), columns=["word", "n"])


def word_ranks(docs: DataFrame) -> dict[str, int]:
    """Ranks of the fixed words and, after them, of the most frequent words of ``docs`` by rows that hold them.

    All words above a count are taken, the lowest count that CORPUS_WORDS of them allow, so only these reach the driver.
    """
    counts = docs.select("text").mapInPandas(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where((F.col("n") >= LEAST_ROWS) & (F.length("word") <= LONGEST_WORD) & ~F.col("word").isin(WORDS)))
    least, room = None, CORPUS_WORDS
    for level in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= level["words"]
        if room < 0:
            break
        least = level["n"]
    found = sorted((-r["n"], r["word"]) for r in counts.where(F.col("n") >= F.lit(least)).collect())
    drop_lineage(counts)
    return RANKS | {w: i for i, (_, w) in enumerate(found, len(WORDS) + 1)}


def _rows(ranks: Mapping[str, int]):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [[{"kind": k, "start": s, "end": e, "log10_guesses": g} for s, k, e, g in find_secrets(t, ranks)] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": found})

    return rows


def secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind as position in KINDS, start, end, log10_guesses), ordered by start and kind.

    One row per row of ``docs``, repeated rows too; positions are code points, ends exclusive. A null or empty text has no
    spans; other columns are ignored; the empty table gives no rows. The words are counted first: one shuffle of counts, of
    which at most the CORPUS_WORDS most frequent reach the driver. The rest of the work is per text.
    """
    ranks = word_ranks(docs)
    return docs.select("doc_id", "text").mapInPandas(_rows(ranks), "doc_id bigint, spans array<struct<kind:int,start:bigint,end:bigint,log10_guesses:double>>")
