"""Text statistics per document, and an ordered rule list that tells prose from lists, tables and junk.

The statistics (words, mean word length, symbols, line endings, common words, and the shares of characters in lines that
look like cells, like items, or like nothing readable) are made in one pass over the texts; what a word adds to them is
looked up, so patterns run once for each different word. Rules over all of them are induced on labelled documents by
incremental reduced-error pruning: a rule is grown on two thirds of the labels, pruned on the rest, kept while it is right
more often than not there, and its documents are removed. The labels of all kinds but prose are pooled: the rules tell
prose from the rest, and the rest's kind is the one with the largest share. So a handful of labels of any kind is enough,
and the same is done at every size. The learned thresholds are exported as one SQL CASE expression and applied natively.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f'’-])*")
#: What makes a word of visible characters, or a part of it, unreadable.
JUNK = re.compile(
    "|".join(
        [
            r"^\S*?(?:[�□▒█¤¶]|Ã[\u0080-¿]|â€)\S*",  # wrong decoding
            r"&nbsp;|^(?:NaN|undefined)$",  # empty markup
            r"0x[0-9a-fA-F]+|^(?=\S*[0-9])(?=\S*[a-f])[0-9a-f]{6,}$|^[0-9a-f]{8,}$|^\.[&!?%][0-9a-f]{2,}",  # dumps
            r"^(?=\S*[a-z])(?=\S*[A-Z])(?=\S*[0-9])[A-Za-z0-9+/=_-]{24,}$",  # encoded data
            r"^([^\s.])\1{2,}$",  # one character again and again
            r"^(?!\.+$)[\W_]{2,}$|^[~^<>=*_+\\{}\[\]§$%&#@]$",  # symbols alone
            r"^[^\W\d_]*[~^<>=*_+\\{}\[\]§$%&#]{2,}\S*|^(?!https?://|www\.)\S*?[~^\\{}§$%&]\S*",
            r"(?<![\w'’])[bcdfghjklmnpqrstvwxz]{2,}(?![\w.'’])",  # no vowel
        ]
    )
)
TAG = re.compile(r"<[^<>\n]{1,80}>")
BULLET = re.compile(r"\s*(?:[-*•–]\s|\(?\w{1,3}[.)]\s|\d+(?:\.\d+)+\.?\s)")
LEADER = re.compile(r"\.{4,}\s*\d*\s*$")
CELL = re.compile(r"(?:[^\W\d_]?\d[\d.,]*%?|n/a|-|yes|no|ok)$")
LINE = re.compile(r"\r\n|[\n\r]")
ENDED = re.compile(r"[.!?][\"')\]]*\s*$")
CLOSED = re.compile(r"[.!?:;…][\"')\]»]*[ \t\r]*$")
LONG = 100  # visible characters in a row from which a string is long
STATISTICS = ["chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "junk_share", "table_share", "list_share", "prose_share"]


class Tokens(dict):
    """For a run of visible characters: (its unreadable characters, whether it fills a cell, words, letters, digits, common
    words). Kept for the next place that has it; emptied when it grows beyond ``LIMIT``."""

    LIMIT = 300_000

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> tuple[int, bool, int, int, int, int]:
        words = WORD.findall(token)
        made = (
            len(token) - len(JUNK.sub("", token)),
            bool(CELL.match(token)),
            len(words),
            sum(c.isalpha() for c in token),
            sum(c.isnumeric() for c in token),
            sum(w.lower() in self.common for w in re.findall(r"[^\W\d_]+", token)),
        )
        if len(token) > LONG:
            return made
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = made
        return made


def _is_table(line: str, tokens: list[str], cells: int) -> bool:
    n = len(tokens)
    if line.lstrip().startswith("|") and line.count("|") > 1 or "\t" in line.strip():
        return True
    if line.count(";") >= 2 and line.count("; ") < 3 and (";;" in line or re.search(r"\S;\S.*\S;\S", line) or re.search(r";\s*$", line)):
        return True
    if ENDED.search(line):
        return False
    if "  " in line and ((n <= 14 and len(re.findall(r"(?<=\S) {2,}(?=\S)", line)) >= 2) or (n <= 8 and re.search(r"\S {3,}\S", line))):
        return True
    return n >= 2 and cells >= 0.4 * n and not BULLET.match(line)


def _is_item(line: str, words: int) -> bool:
    if "...." in line and LEADER.search(line):
        return True
    if BULLET.match(line) and not (words >= 6 and ENDED.search(line)):
        return True
    units = len(re.findall(r";\s", line))
    if units >= 3 and words <= 6 * (units + 1):
        return True
    first = line.lstrip()[:1]
    return words <= 6 and len(line) <= 42 and (first.isupper() or first.isnumeric() or first == "(") and not re.search(r"[.!?,]\s*$|[^\W\d_][-‐­]\s*$", line)


def statistics(text: str | None, known: Tokens) -> tuple:
    """The ``STATISTICS`` of a text; 0 for null, empty and blank ones.

    Shares are of the visible characters in lines of a kind. Both numbers are of whole strings but for a page's only string
    of ``LONG`` characters or more, which weighs as a long word of 80 in the shares."""
    kinds, chars, words, letters, digits, common, ended, lines = [0, 0, 0, 0], 0, 0, 0, 0, 0, 0, 0
    single = bool(text) and len(text) >= LONG and sum(len(t) >= LONG for t in text.split()) == 1
    for line in LINE.split(text or ""):
        tokens = line.split()
        if not tokens:
            continue
        lines += 1
        whole = sum(map(len, tokens))
        chars += whole
        junk, cut = 0, None
        long = next((t for t in tokens if len(t) >= LONG), None) if single and whole >= LONG else None
        if long:  # all of it counts for the numbers, its start for the shares
            _, _, w, n, d, c = known[long]
            words, letters, digits, common, whole = words + w, letters + n, digits + d, common + c, whole - len(long) + 80
            line = line.replace(long, long[:80])
            at = tokens.index(long)
            tokens = line.split()
            cut = tokens[at]
        seen = tokens
        if "<" in line and ">" in line:
            bare = TAG.sub(" ", line)
            seen = bare.split()
            junk = whole - sum(map(len, seen))
        own_words = cells = 0
        for t in tokens:
            j, cell, w, n, d, c = known[t]
            own_words += w
            cells += cell
            if t is not cut:
                words, letters, digits, common = words + w, letters + n, digits + d, common + c
            if seen is tokens:
                junk += j
        if seen is not tokens:
            junk += sum(known[t][0] for t in seen)
        if CLOSED.search(line):
            ended += 1
        kinds[1 if junk >= 0.5 * whole else 2 if _is_table(line, tokens, cells) else 3 if _is_item(line, own_words) else 0] += whole
    counted = max(1, sum(kinds))
    symbols = chars - letters - digits
    return (
        chars, words, letters / max(1, words), symbols / max(1, chars), digits / max(1, chars), ended / max(1, lines), common / max(1, words),
        kinds[1] / counted, kinds[2] / counted, kinds[3] / counted, kinds[0] / counted,
    )


def with_statistics(pages: DataFrame, text_col: str, common: list[str], prefix: str = "") -> DataFrame:
    """``pages`` with one column for each statistic, under ``prefix`` so that no name clashes, in one pass over the texts.

    ``common`` are the frequent words of the languages (a short list).
    """
    frequent = frozenset(w.lower() for w in common if w and w.isalpha())

    @F.pandas_udf("struct<" + ",".join(f"{k}:{'long' if k in ('chars', 'words') else 'double'}" for k in STATISTICS) + ">")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Tokens(frequent)
        for texts in batches:
            yield pd.DataFrame([statistics(t, known) for t in texts], columns=STATISTICS)

    # explode() of one element computes a value once; without it a filter on the result would be pushed down with all of it
    made = pages.withColumn("_s", F.explode(F.array(measure(F.col(text_col)))))
    return made.withColumns({prefix + k: F.col(f"_s.{k}") for k in STATISTICS}).drop("_s")


#: Statistics that rules may use.
FEATURES = ["words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "junk_share", "table_share", "list_share", "prose_share"]


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, ``>=`` or ``<=``, threshold) hold -> label."""

    conditions: tuple[tuple[str, str, float], ...]
    label: str

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, op, at in self.conditions:
            out &= x[name] >= at if op == ">=" else x[name] <= at
        return out

    def sql(self, prefix: str = "") -> str:
        return " AND ".join(f"`{prefix}{name}` {op} {at!r}D" for name, op, at in self.conditions)


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, slack: float = 0.9) -> tuple[str, str, float] | None:
    """A condition by information gain (FOIL) over rows ``y`` (true: the label sought): of those that gain at least
    ``slack`` of the most, the one with the widest gap at its threshold, which lies in the middle of the gap. A few wrong
    labels change the gain by less than that, so they move no threshold into the midst of a kind."""
    p0, n0 = y.sum(), (~y).sum()
    base = np.log2(p0 / (p0 + n0))
    found: list[tuple[float, float, tuple[str, str, float]]] = []
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, hit = v[order], y[order]
        edge = np.flatnonzero(s[1:] > s[:-1]) + 1
        if not len(edge):
            continue
        gap = (s[edge] - s[edge - 1]) / (s[-1] - s[0])
        below = np.cumsum(hit)[edge - 1]
        for op, p, c in (("<=", below, edge), (">=", p0 - below, len(y) - edge)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / c) - base), 0)
            if gain.max() <= 1e-9:
                continue
            near = gain >= slack * gain.max()
            k = np.flatnonzero(near)[np.argmax(gap[near])]
            found.append((float(gain[k]), float(gap[k]), (name, op, float((s[edge[k]] + s[edge[k] - 1]) / 2))))
    top = max((g for g, _, _ in found), default=0.0)
    if not found:
        return None
    return max((f for f in found if f[0] >= slack * top), key=lambda f: (f[1], f[0]))[2]


def induce(x: dict[str, np.ndarray], labels: np.ndarray, default: str, seed: int = 5, most_rules: int = 8) -> list[Rule]:
    """Ordered rules for every label but the default, rarest label first."""
    rng = np.random.default_rng(seed)
    names, counts = np.unique(labels, return_counts=True)
    left = np.ones(len(labels), dtype=bool)
    rules: list[Rule] = []
    take = lambda rows: {k: v[rows] for k, v in x.items()}
    for label in (n for _, n in sorted(zip(counts, names)) if n != default):
        for _ in range(most_rules):
            rows = np.flatnonzero(left)
            y = labels[rows] == label
            if y.sum() < 2:
                break
            grow = np.zeros(len(rows), dtype=bool)
            for part in (np.flatnonzero(y), np.flatnonzero(~y)):
                grow[rng.permutation(part)[: -(-2 * len(part) // 3)]] = True
            conditions: list[tuple[str, str, float]] = []
            at = rows[grow]
            while (labels[at] != label).any() and len(conditions) < 4:
                found = _best_condition(take(at), labels[at] == label)
                if found is None:
                    break
                conditions.append(found)
                at = rows[grow][Rule(tuple(conditions), label).covers(take(rows[grow]))]
            held = rows[~grow]

            def worth(k: int) -> tuple[float, int]:
                hit = labels[held][Rule(tuple(conditions[:k]), label).covers(take(held))] == label
                return ((hit.sum() - (~hit).sum()) / max(1, len(hit)) if len(hit) else -1.0, -k)

            if not conditions:
                break
            keep = max(range(1, len(conditions) + 1), key=worth)
            rule = Rule(tuple(conditions[:keep]), str(label))
            right = labels[rows][rule.covers(take(rows))] == label
            if (worth(keep)[0] <= 0 and (labels[held] == label).any()) or right.sum() < 2 or right.mean() <= 2 / 3:
                break
            rules.append(rule)
            left &= ~rule.covers(x)
    return rules


def case_expression(rules: list[Rule], default: str, kinds: tuple[str, ...], prefix: str = "") -> str:
    """The rules as one CASE expression; where one covers a document, its kind is the first of ``kinds`` with the largest share."""
    if not rules:
        return f"'{default}'"
    shares = [f"`{prefix}{k}_share`" for k in kinds]
    largest = " ".join(f"WHEN {s} >= greatest({', '.join(shares)}) THEN '{k}'" for s, k in zip(shares, kinds)) if len(kinds) > 1 else ""
    kind = f"CASE {largest} END" if largest else f"'{kinds[0]}'"
    return "CASE " + " ".join(f"WHEN {r.sql(prefix)} THEN {kind if r.label != default else repr(default)}" for r in rules) + f" ELSE '{default}' END"


def labelled(labels: DataFrame, item_col: str, label_col: str, kinds: list[str], most: int) -> DataFrame:
    """(``item``, ``label``): the label most reviewers gave, of at most ``most`` items drawn by a hash of the item.
    Labels are compared trimmed and in lower case; null and unknown ones and ties are left out."""
    clean = labels.select(F.col(item_col).alias("item"), F.lower(F.trim(label_col)).alias("label")).filter(F.col("label").isin(kinds))
    votes = clean.groupBy("item", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("item").agg(F.max(F.struct("n", "label")).alias("top"), F.max("n").alias("n"), F.collect_list("n").alias("all"))
    best = best.filter(F.size(F.filter("all", lambda v: v == F.col("n"))) == 1)
    return best.select("item", F.col("top.label").alias("label")).orderBy(F.xxhash64("item"), "item").limit(most)


OTHER = "other"


def classify(pages: DataFrame, id_col: str, text_col: str, labels: DataFrame, common: list[str], default: str = "prose", kinds: tuple[str, ...] = ("junk", "table", "list"), most_labels: int = 20_000) -> tuple[DataFrame, list[Rule]]:
    """(pages with their statistics under ``stat_`` and ``kind``, the rules).

    ``labels(item_col='item_id', 'label')`` are used up to ``most_labels`` items (the bound of what is collected and
    broadcast). Pages without visible text have a null kind. Without usable labels nothing is told from the default.
    """
    made = with_statistics(pages, text_col, common, "stat_")
    known = F.broadcast(labelled(labels, "item_id", "label", [default, *kinds], most_labels))
    seen = pages.select(F.col(id_col).alias("item"), F.col(text_col).alias("_text")).join(known, "item").dropDuplicates(["item"])
    rows = with_statistics(seen, "_text", common).filter("chars > 0").select("item", "label", *FEATURES).toPandas().sort_values("item")
    pooled = np.where(rows["label"].to_numpy(dtype=object) == default, default, OTHER).astype(str)
    rules = induce({k: rows[k].to_numpy(dtype=float) for k in FEATURES}, pooled, default)
    kind = F.when(F.col("stat_chars") > 0, F.expr(case_expression(rules, default, kinds, "stat_")))
    return made.withColumn("kind", kind), rules


def as_metadata(pages: DataFrame, metadata_col: str = "metadata") -> DataFrame:
    """``pages`` with their ``stat_`` columns and ``kind`` as values of a map of texts; earlier values of these keys go."""
    names = [c for c in pages.columns if c.startswith("stat_")]
    old = F.coalesce(F.map_filter(metadata_col, lambda k, _: ~k.startswith("stat_")), F.create_map().cast("map<string,string>"))
    text = lambda c: (F.round(c, 6) if c != "stat_chars" and c != "stat_words" and c != "kind" else F.col(c)).cast("string")
    more = F.map_from_arrays(F.array(*[F.lit(n) for n in names], F.lit("stat_kind")), F.array(*[text(n) for n in names], text("kind")))
    return pages.withColumn(metadata_col, F.map_concat(old, more)).drop(*names)
