"""Secret scans by a trigram inverted index. DataFrame functions only.

A Boolean query over trigrams is derived from each rule's regular expression: what any match must hold. A text is indexed in
one pass by the trigrams of these queries that it holds; postings() gives that index as a table (trigram, document). The
posting sets that a query asks for are intersected in the row that holds the text, so no text ever moves, and rules are
verified on their candidates only. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping, whose group has least signs or more; the span is the match.

    pattern must mean the same to Java, Python and RE2."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


def either_case(words: str) -> str:
    """ASCII letters in either case, spelled out: engines differ in which other letters they fold."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: The base rules, in their order, and those that are added to them.
RULES = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # what remains of the matches of [0-9a-f]+ without the shorter ones
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
#: Strings of one alternative part that are followed one by one; beyond, the part counts as unknown.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of the outer list must hold; of each inner list one set, with all its trigrams. Trigrams are in lower case.

    Empty if nothing is mandatory. Strings that any match holds in a row are followed through the parsed expression."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def exact(items) -> set[str] | None:
        """The strings that a part can match, or None if they are too many."""
        strings = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                found = {chr(arg).lower()}
            elif op is sre.IN:
                if any(o is not sre.LITERAL for o, _ in arg):
                    return None
                found = {chr(a).lower() for _, a in arg}
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                if None in parts:
                    return None
                found = set().union(*parts)
            elif op is sre.SUBPATTERN:
                found = exact(arg[3])
            elif op is sre.MAX_REPEAT and arg[1] <= 4 and (one := exact(arg[2])) is not None:
                found = {"".join(x) for k in range(arg[0], arg[1] + 1) for x in itertools.product(sorted(one), repeat=k)} if len(one) ** arg[1] <= MOST_STRINGS else None
            else:
                return None
            if found is None or len(strings) * len(found) > MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in found}
        return strings

    def walk(items, strings: set[str]) -> set[str]:
        for item in items:
            op, arg = item
            found = exact([item])
            if found is None and op is sre.SUBPATTERN:
                strings = walk(arg[3], strings)
                continue
            if found is None or len(strings) * len(found) > MOST_STRINGS or (op is sre.MAX_REPEAT and arg[0] == 0):
                close(strings)
                strings = found if found is not None and op is not sre.MAX_REPEAT else {""}
            else:
                strings = {a + b for a in strings for b in found}
        return strings

    close(walk(sre_parser.parse(pattern), {""}))
    return clauses


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for strings in clause for t in strings})


def gates(rules: tuple[Rule, ...]) -> list[str]:
    """Few trigrams of which any text holds one that meets some rule's query: of each rule the shortest clause, of each of its
    sets one trigram, one of rare signs and held by several sets if there is such a one."""
    plain = "etaoinshrdlucmfwypvbgkqjxz"
    left = [s for r in rules if (q := trigram_query(r.pattern)) for s in min(q, key=len)]
    chosen = []
    while left:
        rank = lambda t: (sum(plain.find(c) % 27 for c in t) + 5 * sum(t in s for s in left), t)
        chosen.append(max(sorted(set().union(*left)), key=rank))
        left = [s for s in left if chosen[-1] not in s]
    return chosen


def held_trigrams(text: Column, trigrams: list[str]) -> Column:
    """The given trigrams that a text in lower case holds, found in one pass: by their first sign, then by the rest."""
    if not trigrams:
        return F.array().cast("array<string>")
    by_first = itertools.groupby(sorted(trigrams), key=lambda t: t[0])
    tree = "|".join(f"{re.escape(first)}(?:{'|'.join(re.escape(t[1:]) for t in own)})" for first, own in by_first)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({tree}))"), F.lit(1)))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index as a table (trigram, key): one row for each trigram of the rules' queries that a row's text holds."""
    return docs.select(F.explode(held_trigrams(F.lower(F.col(text)), trigrams_of(rules))).alias("trigram"), F.col(key).alias("_doc")).withColumnRenamed("_doc", key)


def meets(rule: Rule, held: Column) -> Column:
    """Whether a text with these trigrams meets the rule's query."""
    all_of = lambda strings: reduce(lambda a, b: a & b, (F.array_contains(held, t) for t in sorted(strings)))
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(all_of, clause)) for clause in trigram_query(rule.pattern)))


SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


#: Elements that running() appends to one array before it begins the next.
TOGETHER = 512


def running(items: Column, kind: str, step) -> Column:
    """Lists appended by step, which takes (at, item) and gives (at, list): at goes on from item to item. (at, array) at the end.

    An append copies its array, so items are taken in runs of TOGETHER whose arrays are put together at the end."""
    none = F.array().cast(kind)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / TOGETHER).cast("int")), lambda k: F.slice(items, k * TOGETHER + 1, TOGETHER))

    def one(acc: Column, x: Column) -> Column:
        # What is used twice stands in an array of one, else it would be computed twice.
        return F.transform(F.array(step(acc["at"], x)), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["list"], r["list"]).alias("list")))[0]

    def run(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("list")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["list"], F.array(r["list"])).alias("list")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("list"))
    found = F.aggregate(runs, start, run, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["list"]).alias("list")))
    return F.when(F.size(items) > 0, found).otherwise(F.struct(F.lit(0).alias("at"), none.alias("list")))


def spans_of(rule: Rule, number: int, text: Column) -> Column:
    """Spans of a rule in a text, in code points, end exclusive. What stands between matches gives their places."""
    between, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pairs = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(groups, F.length).alias("held"))
    pairs = F.filter(pairs, lambda x: x["size"].isNotNull())

    def step(at: Column, x: Column) -> Column:
        begin = at + x["gap"]
        end = begin + x["size"]
        one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind"))).cast(SPANS)
        return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, one).otherwise(F.array().cast(SPANS)).alias("list"))

    return F.when(text.rlike(rule.pattern), running(pairs, SPANS, step)["list"]).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds secret_spans, the spans of all rules by start, then rule: array of (start, kind_no, end, kind). Null text: none.

    Rows are kept one for one, each decided by itself; a column of this name is replaced. Nothing is shuffled."""
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("secret_spans", "_held")])
    whole, trigrams = F.coalesce(F.col(text), F.lit("")), trigrams_of(rules)
    # Texts without any of the gates meet no query and aren't indexed; what is used more than once is a column of its own.
    low = kept.withColumn("_held", F.lower(whole))
    gate = reduce(lambda a, b: a | b, (F.contains("_held", F.lit(t)) for t in gates(rules)), F.lit(False))
    held = low.withColumn("_held", F.when(gate, held_trigrams(F.col("_held"), trigrams)).otherwise(F.array().cast("array<string>")))
    none = F.array().cast(SPANS)
    by_rule = [F.when(meets(r, F.col("_held")), spans_of(r, n, whole)).otherwise(none) if trigram_query(r.pattern) else spans_of(r, n, whole) for n, r in enumerate(rules)]
    return held.withColumn("secret_spans", F.array_sort(F.concat(*by_rule))).drop("_held")


def written(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs, from scan()."""
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    of_kind = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return scan(docs.select(key, text), rules, text).select(key, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Each run of overlapping spans becomes mark; the other columns stay as they are, but for one that is named secret_spans.
    A null text stays null."""
    parts = "array<string>"

    def step(at: Column, s: Column) -> Column:
        fresh = F.array(F.substring(F.col(text), at + 1, s["start"] - at), F.lit(mark))
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] >= at, fresh).otherwise(F.array().cast(parts)).alias("list"))

    found = scan(docs, rules, text)
    whole = F.transform(F.array(running(F.col("secret_spans"), parts, step)), lambda r: F.concat(F.array_join(r["list"], ""), F.substring(F.col(text), r["at"] + 1, F.length(text))))[0]
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, whole).otherwise(F.col(text))).drop("secret_spans")
