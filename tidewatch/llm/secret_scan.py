"""Secrets in texts, weighed by how many owners and repositories hold the same value.

Each text is scanned once; a staged table keeps spans and 128-bit hashes of their values, no text. Hashes are counted by
distinct repository and owner with map-side aggregates, so one value may stand in a third of all
documents. A value that ``EXAMPLE_OWNERS`` owners or ``EXAMPLE_REPOSITORIES`` repositories or more hold is a widely copied example;
below both it looks live.
Spans of the fixed patterns are always reported. The frequency adds spans of kind ``opaque``: long
runs of mixed letters and digits that no pattern names and that look live. DataFrame functions only.

Defined results: null text counts as empty; a null owner or repository is one of its own; positions are code points,
end exclusive. Rows equal in id and text are one document and all are returned. Extra columns are ignored by
``secret_report`` and kept by ``redact_secrets``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import pick, row_key, staged

# The patterns, their kinds in the order of equal starts, and the lengths that matches must have.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LENGTH = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "opaque"]

#: Long runs that may be keys of no known form; they must hold a letter and a digit.
OPAQUE = "[A-Za-z0-9+/_=-]{20,}"
#: A value of this many distinct owners is a copied example.
EXAMPLE_OWNERS = 3
#: So is one of this many distinct repositories, whoever owns them.
EXAMPLE_REPOSITORIES = 10

_SPAN = "struct<start:int,kind:int,end:int,h1:bigint,h2:bigint>"


def _spans(kind: int, pattern: str, matches: str, values: str) -> Column:
    """Spans of all matches. Text between matches comes from a split by the same pattern."""
    between = F.split("text", pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), F.col(matches).alias("match"), F.col(values).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc, m):
        at = acc["at"] + F.char_length(m["gap"])
        end = at + F.char_length(m["match"])
        span = F.struct(
            at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
            F.xxhash64(m["value"]).alias("h1"), F.xxhash64(F.lit(7), m["value"]).alias("h2"),
        )
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span.cast(_SPAN))).alias("out"))

    found = F.aggregate(pairs, start, step)["out"]
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scanned(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, owner, repository, base, opaque): spans of each document, from one pass over its text."""
    text = F.coalesce("text", F.lit(""))
    own = [F.xxhash64(F.col(c).isNull(), F.col(c)).alias(c) for c in ("owner", "repository")]
    matched = docs.select(
        *row_key("doc_id", "text"),
        "doc_id",
        *own,
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(ASSIGN), 0).alias("assign"),
        F.regexp_extract_all(text, F.lit(ASSIGN), 2).alias("assign_value"),
        F.regexp_extract_all(text, F.lit(ACCESS), 0).alias("access"),
        F.regexp_extract_all(text, F.lit(HEX), 0).alias("hex"),
        F.regexp_extract_all(text, F.lit(OPAQUE), 0).alias("opaque"),
    )
    spans = matched.select(
        "k1", "k2", "doc_id", "owner", "repository", "opaque", "assign_value",
        _spans(0, ASSIGN, "assign", "assign_value").alias("s_assign"),
        _spans(1, ACCESS, "access", "access").alias("s_access"),
        _spans(2, HEX, "hex", "hex").alias("s_hex"),
        F.when(F.exists("opaque", _mixed), _spans(3, OPAQUE, "opaque", "opaque")).otherwise(F.array().cast(f"array<{_SPAN}>")).alias("s_opaque"),
    )
    assigned = F.filter("s_assign", lambda s, i: F.char_length(F.get("assign_value", i)) >= ASSIGN_LENGTH)
    mixed = F.filter("s_opaque", lambda s, i: _mixed(F.get("opaque", i)))
    base = spans.select(
        "k1", "k2", "doc_id", "owner", "repository", mixed.alias("mixed"),
        F.sort_array(F.concat(assigned, "s_access", "s_hex")).alias("base"),
    )
    apart = F.filter("mixed", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return base.select("k1", "k2", "doc_id", "owner", "repository", "base", apart.alias("opaque"))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(found: DataFrame) -> DataFrame:
    """(h1, h2, n_owners, n_repositories) of every candidate value."""
    held = found.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("s"))
    held = held.select(F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"), "owner", "repository")
    by_repository = held.groupBy("h1", "h2", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def weighed(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(k1, k2, doc_id, base, added, n_live, n_example), a row per row of ``docs``."""
    found = staged(scanned(docs), "secrets")
    counts = ownership(found)
    rows = found.select("k1", "k2", F.explode(F.concat("base", "opaque")).alias("s")).distinct()
    rows = rows.select("k1", "k2", "s", F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2")).join(counts, ["h1", "h2"])
    live = (F.col("n_owners") < example_owners) & (F.col("n_repositories") < example_repositories)
    per_document = rows.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.when(live & (F.col("s.kind") == 3), F.col("s")))).alias("added"),
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_example"),
    )
    none = F.array().cast(f"array<{_SPAN}>")
    return found.join(per_document, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "base", F.coalesce("added", none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_report(
    docs: DataFrame, id_column="doc_id", text_column="text", owner_column="source", repository_column="doc_id"
) -> DataFrame:
    """Per document: counts by kind, digest of the base spans, all spans, values that look live and examples."""
    docs = pick(docs, doc_id=id_column, text=text_column, owner=owner_column, repository=repository_column)

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return weighed(docs).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        "n_live", "n_example",
    )


def redact_secrets(
    docs: DataFrame, id_column="doc_id", text_column="text", owner_column="source", repository_column="doc_id", mark="[SECRET]"
) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans become one mark."""
    narrow = pick(docs, doc_id=id_column, text=text_column, owner=owner_column, repository=repository_column)
    spans = weighed(narrow).where("size(base) + size(added) > 0")
    spans = spans.select("k1", "k2", F.sort_array(F.concat("base", "added")).alias("spans")).distinct()
    all_columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    left = docs.select(all_columns.alias("row"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    joined = left.select("row", "text", *row_key("doc_id", "text")).join(spans, ["k1", "k2"], "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["out"], gap, F.lit(mark))
        overlaps = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(overlaps, acc["out"]).otherwise(fresh).alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.when(
        F.col("spans").isNotNull(),
        F.concat(F.col("done.out"), F.substring(F.col("text"), F.col("done.at") + 1, F.char_length("text"))),
    ).otherwise(F.col("text"))
    out = joined.select("row", "text", "spans", F.when(F.col("spans").isNotNull(), done).alias("done")).select("row", text.alias("redacted"))
    return out.select(*[(F.col("redacted") if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
