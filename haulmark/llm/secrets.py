"""Secret scans with corpus-wide ownership, in DataFrame functions alone.

Base spans are what the three patterns match. The method adds spans: the value of every
candidate is hashed and counted over distinct repositories and owners; a value of mixed characters
in few repositories of few owners looks live, a value that is in many repositories or with many
owners looks like a copied example. Bare values (long words of letters and digits without a keyword)
are candidates too, and those that look live become spans of the kind 'bare' where they touch no
base span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, numbered

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of 24 and more are the same matches as runs that are then measured.
LONG_HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A value of more owners or repositories is a copied example.
MOST_OWNERS, MOST_REPOS = 2, 4
#: Values that make up more than one part in WIDE of all candidates are broadcast: fewer than WIDE of them.
WIDE = 4096
#: Matches whose lengths are run over at once.
BLOCK = 128


def running(lengths: Column) -> Column:
    """For each element the sum of those before it. Sums run inside blocks and over the blocks' totals,
    as an array that grows by one element a step is copied at every step."""

    def run(values: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    def cut(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y))
        return F.flatten(F.zip_with(blocks, run(totals, F.lit(0)), run))

    return _once(_once(lengths, cut), whole)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once, however often f's lambdas look at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """array<struct<start, end, kind, value>> of leftmost non-overlapping matches, in code points.

    `group` 0 is the whole match. Gaps between matches come from splitting at the same pattern.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    sizes = F.transform(whole, lambda w: F.length(w))
    found = F.arrays_zip(running(F.zip_with(gaps, sizes, lambda g, w: g + F.coalesce(w, F.lit(0)))).alias("at"), gaps.alias("gap"), sizes.alias("size"), values.alias("value"))
    kept = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(kept, lambda x: F.struct((x["at"] + x["gap"]).alias("start"), (x["at"] + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def find_spans(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep`, and `spans` and `bare`: arrays of (start, end, kind, value); null texts are empty.

    A cheap test comes before each pattern's split, so that most texts are read once by each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")

    def guarded(test: str, spans: Column) -> Column:
        return F.when(body.rlike(test), spans).otherwise(none)

    return docs.select(
        *keep,
        F.concat(
            guarded(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", _spans(body, ASSIGN, 0, 2, LEAST["assign"])),
            F.when(F.contains(body, F.lit("AKIA")), _spans(body, ACCESS, 1, 0, LEAST["access"])).otherwise(none),
            guarded(LONG_HEX, _spans(body, LONG_HEX, 2, 0, LEAST["hex"])),
        ).alias("spans"),
        guarded(BARE, _spans(body, BARE, 3, 0, 0)).alias("bare"),
    )


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, and no few characters over and over."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= 8)


def ownership(candidates: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """(hash, n_docs, n_repos, n_owners, live) of each candidate value of (hash, looks, repo, owner), a row
    for each document that has it.

    Two steps of grouping, so that a value that a third of all rows share is counted by many
    tasks: by value, repository and owner first, of which only the few distinct ones meet. A
    repository is one of its owner's.
    """
    by_repo = candidates.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("looks").alias("looks"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), F.max("looks").alias("looks"))
    whole = by_owner.groupBy("hash").agg(
        F.sum("n").alias("n_docs"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("looks").alias("looks"))
    live = F.col("looks") & (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    return whole.select("hash", "n_docs", "n_repos", "n_owners", live.alias("live"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", repo: str = "repo", owner: str = "owner") -> DataFrame:
    """One row for each row of `docs`: key, `spans` (start, end, kind, value, hash, n_docs, n_repos,
    n_owners, live) by start and then kind. Kinds are indexes of KINDS.

    Null and empty texts have no spans; very long texts are searched whole; spans of different kinds
    that start together go by kind; null repositories and owners count as one each; repeated rows are
    kept and count as documents of the same owner; other columns are left out; an empty table gives an
    empty table. `docs` is read once.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(repo).alias("repo"), F.col(owner).alias("owner"))
    found = numbered(find_spans(docs, "text", ["key", "repo", "owner"]), "row")
    every = F.concat("spans", "bare")
    spans = found.where(F.size(every) > 0).select("row", "repo", "owner", F.explode(every).alias("span"))
    # bare values that touch a base span go: the furthest end so far and the next start tell
    base, at = F.col("span.kind") < 3, F.col("span.start")
    before = F.max(F.when(base, F.col("span.end"))).over(W.partitionBy("row").orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(F.when(base, at)).over(W.partitionBy("row").orderBy(at.desc()).rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumns({"before": before, "after": after})
    free = base | ((F.coalesce("before", F.lit(0)) <= at) & (F.coalesce("after", F.col("span.end")) >= F.col("span.end")))
    value = F.col("span.value")
    each = materialize(spans.where(free).select("row", "repo", "owner", "span", F.xxhash64(value).alias("hash"), live_looking(value).alias("looks")))
    known = materialize(ownership(each.select("row", "repo", "owner", "hash", "looks").distinct()))
    total = known.agg(F.sum("n_docs")).first()[0] or 0
    each = each.select("row", "span", "hash")
    # values in a large share of all documents are few, and don't meet in a task of their own
    wide = F.broadcast(known.where(F.col("n_docs") * WIDE > total))
    rest = known.where(F.col("n_docs") * WIDE <= total)
    joined = each.join(wide, "hash").unionByName(each.join(wide.select("hash"), "hash", "left_anti").join(rest, "hash"))
    joined = joined.where((F.col("span.kind") < 3) | F.col("live"))
    one = F.struct("span.start", "span.kind", "span.end", "span.value", "hash", "n_docs", "n_repos", "n_owners", "live")
    by_row = joined.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("all"))
    empty = F.array().cast(by_row.schema["all"].dataType)
    return found.join(by_row, "row", "left").select(F.col("key").alias(key), F.coalesce("all", empty).alias("spans"))


def joined_spans(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
