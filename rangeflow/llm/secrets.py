"""Secret scans with a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression gives a Boolean trigram query
   (:mod:`.trigrams`).
2. Postings (trigram, document) are made for the trigrams that any query asks for: one
   pass over the texts finds the rarest trigram of each clause, and only where that one is
   the others of the clause are looked for, rarest first. They are joined with the clauses of
   the queries and intersected for each document and clause: the bits of the trigrams
   found must make up the clause.
3. Only documents with a satisfied clause are searched with the rule's regular
   expression; rules without mandatory trigrams search all documents.

Places are code points. A match is located from the lengths of what lies
between matches (``split``) and of the matches themselves, summed along the
match array in the document's own row: no row is numbered, exploded or grouped again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, disguised, small
from .trigrams import by_rarity, one_pass, trigram_query


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret. Matches of ``pattern`` count if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_VALUE = "[A-Za-z0-9+/_.=-]+"

#: The base kinds, in the order in which ties are listed.
BASE_RULES = (
    SecretRule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + _VALUE + ")", 1, 12),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", "[0-9a-f]{16,}"),  # runs are maximal, so shorter ones needn't be matched first
)

#: Further kinds, by their fixed prefixes.
MORE_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", "AIza[0-9A-Za-z_-]{35,}"),
    SecretRule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

RULES = BASE_RULES + MORE_RULES


#: Matches of a text that are summed in one go; more take several, so that time stays in proportion.
STEP = 256
_SPANS = "array<struct<start:bigint,kind:int,end:bigint,start_byte:bigint,end_byte:bigint,counts:boolean>>"


def postings(docs: DataFrame, clauses: list[frozenset[str]]) -> DataFrame:
    """The inverted index for the trigrams of these clauses: (trigram, doc_id), as far as a clause may hold."""
    ordered = [by_rarity(c) for c in clauses]
    low = docs.select("doc_id", F.lower("text").alias("low"))
    low = low.withColumn("first", F.array_distinct(F.regexp_extract_all("low", F.lit(one_pass(sorted({c[0] for c in ordered}))), F.lit(1))))
    none = F.array().cast("array<string>")
    found = []
    for first, *others in ordered:
        more = none
        for gram in reversed(others):
            more = F.when(F.contains("low", F.lit(gram)), F.concat(F.array(F.lit(gram)), more)).otherwise(none)
        found.append(F.when(F.array_contains("first", first), F.concat(F.array(F.lit(first)), more)).otherwise(none))
    return low.where(F.size("first") > 0).select(F.explode(F.array_distinct(F.concat(*found))).alias("trigram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(doc_id, may): bit i of ``may`` is set if rule i's query holds for the document."""
    spark = docs.sparkSession
    clauses = []
    for i, rule in enumerate(rules):
        for j, grams in enumerate(trigram_query(rule.pattern) or []):
            clauses += [(i, j, 1 << k, (1 << len(grams)) - 1, t) for k, t in enumerate(sorted(grams))]
    table = spark.createDataFrame(clauses, "rule int, clause int, bit long, full long, trigram string")
    index = postings(docs, [c for rule in rules for c in trigram_query(rule.pattern) or []])
    # the clauses are as many as the rules say, whatever the corpus
    met = index.join(F.broadcast(table), "trigram").groupBy("doc_id", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = full").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("may"))


def _matches(rule: SecretRule, may: Column) -> Column:
    """Array of matches: gap before, length, and whether it counts; null where there are none."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"),
        F.split("text", rule.pattern, -1).alias("p"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("v"),
    )
    each = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(
            F.length(x["p"]).cast("long").alias("gap"),
            F.octet_length(x["p"]).cast("long").alias("gap_bytes"),
            F.length(x["m"]).cast("long").alias("len"),
            F.octet_length(x["m"]).cast("long").alias("len_bytes"),
            (F.length(x["v"]) >= rule.least).alias("counts"),
        ),
    )
    return F.when(may & F.rlike("text", pattern), each)


def _running(items: str, start: Column, step, shown, kind: str) -> Column:
    """``shown(state, x)`` of each item x, where ``step`` leads from one state to the next.

    Appending to an array copies it, so items go in steps of ``STEP`` into arrays of their own.
    """

    def some(acc: Column, at: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("own"), acc["out"].alias("out"))
        add = lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["own"], F.array(shown(a["state"], x))).alias("own"), a["out"].alias("out"))
        done = lambda a: F.struct(a["state"].alias("state"), F.concat(a["out"], F.array(a["own"])).alias("out"))
        return F.aggregate(F.slice(items, at * STEP + 1, F.lit(STEP)), begin, add, done)

    steps = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int"))
    whole = F.aggregate(steps, F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), some, lambda a: F.flatten(a["out"]))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(kind))


def _placed(items: str, kind: int) -> Column:
    """Spans of one rule's matches, in code points and bytes."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), (s["byte"] + x["gap_bytes"] + x["len_bytes"]).alias("byte"))
    shown = lambda s, x: F.struct(
        (s["at"] + x["gap"]).alias("start"),
        F.lit(kind).alias("kind"),
        (s["at"] + x["gap"] + x["len"]).alias("end"),
        (s["byte"] + x["gap_bytes"]).alias("start_byte"),
        (s["byte"] + x["gap_bytes"] + x["len_bytes"]).alias("end_byte"),
        x["counts"].alias("counts"),
    )
    return F.filter(_running(items, zero, step, shown, _SPANS), lambda x: x["counts"])


def with_spans(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text and columns of no name used here) with ``all``: the spans that count, in order.

    What the postings leave, a row (id, bits) for each document that may have a match, is written
    first and counted: up to a million are broadcast, and more join by doc_id.
    """
    named = cut(candidates(docs, rules).withColumnRenamed("doc_id", "of_doc"), "candidates")
    joined = docs.join(small(named), docs["doc_id"].eqNullSafe(named["of_doc"]), "left").drop("of_doc")
    may = F.coalesce("may", F.lit(0).cast("long"))
    found = {
        f"found{i}": _matches(r, F.lit(True) if trigram_query(r.pattern) is None else may.bitwiseAND(F.lit(1 << i)) != 0)
        for i, r in enumerate(rules)
    }
    placed = joined.withColumns(found).withColumn("all", F.sort_array(F.concat(*[_placed(f"found{i}", i) for i in range(len(rules))])))
    return placed.drop("may", *found)


def _count(kind: int) -> Column:
    return F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """(doc_id, n_<kind> of the first ``base`` rules, base_sha256, spans) for each row.

    docs has ``doc_id`` and ``text``; other columns are ignored. Null texts
    count as empty; null ids stay null; repeated rows each get a row; an empty
    table gives none. ``spans`` lists kind:start:end by start, then by the
    order of the rules, in code points with the end exclusive; matches of one
    rule never overlap, those of different rules may.
    """
    names = F.array(*[F.lit(r.kind) for r in rules])
    placed = with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), rules)

    def listed(of: Column) -> Column:
        show = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
        return F.array_join(F.transform(of, show), ",")

    own = F.filter("all", lambda x: x["kind"] < base)
    counts = [_count(i).alias(f"n_{rules[i].kind}") for i in range(base)]
    return placed.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` (overlapping and touching spans become one).

    All rows and columns stay, whatever their names; ``n_chars``, if there and text changes,
    follows the new text. Null texts stay null, empty ones empty; null ids and repeated rows
    are rows like others; an empty table gives none. A text is cut in the row in which
    it was searched.
    """
    rows, _, back = disguised(docs)
    placed = with_spans(rows, rules)
    # each span with the end of all before it; the text between those that leave a gap is kept
    step = lambda reach, x: F.greatest(reach, x["end_byte"])
    shown = lambda reach, x: F.struct(F.greatest(reach, F.lit(0).cast("long")).alias("from"), x["start_byte"].alias("to"), (x["start_byte"] > reach).alias("apart"))
    kept = F.filter(_running("all", F.lit(-1).cast("long"), step, shown, "array<struct<from:bigint,to:bigint,apart:boolean>>"), lambda x: x["apart"])
    raw = F.col("text").cast("binary")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    tail = part(F.array_max(F.transform("all", lambda x: x["end_byte"])), F.octet_length("text").cast("long"))
    new = F.array_join(F.concat(F.transform("_kept", lambda x: part(x["from"], x["to"])), F.array(tail)), mark)
    changed = F.size("all") > 0
    out = placed.withColumn("_kept", F.when(changed, kept)).withColumn("_new", F.when(changed, new).otherwise(F.col("text")))
    own = dict(zip(docs.columns, back, strict=True))
    own["text"] = F.col("_new").alias("text")
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.coalesce(changed, F.lit(False)), F.length("_new").cast(kind)).otherwise(back[docs.columns.index("n_chars")]).alias("n_chars")
    return out.select(*[own[c] for c in docs.columns])
