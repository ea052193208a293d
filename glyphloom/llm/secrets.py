"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphloom.session import checkpointed

# Fixed formats of the base kinds: pattern, group of the value, least length of the value.
BASE = {
    "assign": ("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
               "([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
# A run this long with both cases and a digit looks like a key, whatever stands before it.
RUN = "[A-Za-z0-9+/_-]{20,}"
ADDED = "live"
REPOS = 10  # a value in more repositories is an example, whoever owns them
KINDS = [*BASE, ADDED]
_HIT = "array<struct<kind_no:int,start:int,finish:int,value:string>>"


def _hits(text: Column, pattern: str, group: int, kind_no: int, keep) -> Column:
    """Kept matches of one pattern with their places in code points.

    Splitting by the pattern gives the gaps between the matches, so a running sum over
    gaps and matches gives each place; a match that is not kept still moves the sum.
    """
    regex = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"),
                         F.regexp_extract_all(text, regex, F.lit(group)).alias("value"))
    zero = F.struct(F.lit(0).alias("place"), F.lit(None).cast(_HIT).alias("hits"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["place"] + F.length(part["gap"])
        finish = start + F.coalesce(F.length(part["whole"]), F.lit(0))
        hit = F.array(F.struct(F.lit(kind_no).alias("kind_no"), start.alias("start"),
                               finish.alias("finish"), part["value"].alias("value"))).cast(_HIT)
        return F.struct(finish.alias("place"), F.when(
            part["whole"].isNotNull() & keep(part["value"]),
            F.when(acc["hits"].isNull(), hit).otherwise(F.concat(acc["hits"], hit))
        ).otherwise(acc["hits"]).alias("hits"))

    none = F.array().cast(_HIT)
    return F.when(F.regexp_like(text, regex), F.coalesce(
        F.aggregate(parts, zero, step, lambda acc: acc["hits"]), none)).otherwise(none)


def candidates(docs: DataFrame, text_col: str) -> Column:
    """All candidate spans of a text: the base kinds and key-like runs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = [_hits(text, pattern, group, number, lambda v, least=least: F.length(v) >= least)
             for number, (pattern, group, least) in enumerate(BASE.values())]
    mixed = lambda v: (F.regexp_like(v, F.lit("[A-Z]"))
                       & F.regexp_like(v, F.lit("[a-z]")) & F.regexp_like(v, F.lit("[0-9]")))
    return F.concat(*found, _hits(text, RUN, 0, KINDS.index(ADDED), mixed))


def ownership(hits: DataFrame) -> DataFrame:
    """``(digest, n_repos, n_owners)`` over all candidates.

    Distinct pairs come first, so a value that stands in a third of all rows is spread by
    the other half of the pair and counted by partial sums.
    """
    def distinct(column: str, name: str) -> DataFrame:
        return hits.select("digest", column).distinct().groupBy("digest").agg(
            F.count(F.lit(1)).alias(name))

    return distinct("repo", "n_repos").join(distinct("owner", "n_owners"), "digest")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 repo_col: str = "doc_id", owner_col: str = "source", owners: int = 1,
                 repos: int = REPOS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id``, the columns of ``carry`` under names that begin with
    ``kept_``, and ``spans``, all spans as an array of ``(start, kind_no, finish, live)``
    ordered by start, then kind.

    Every candidate value is counted over the corpus by distinct repositories and distinct
    owners.  ``live`` marks values that at most ``owners`` owners hold in at most ``repos``
    repositories; others are widely copied examples, be it across owners or within one.  Base kinds are always reported; a key-like run is
    reported only if it is live.  Null text is empty and has no spans; a null owner or
    repository counts as one of its own; repeated rows are scanned each by itself; an empty
    table gives an empty result.  Column names other than those given are not read.
    """
    scanned = checkpointed(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        *[F.col(c).alias(f"kept_{c}") for c in carry],
        candidates(docs, text_col).alias("hits")))
    hits = scanned.where(F.size("hits") > 0).select(
        "row_no", "repo", "owner", F.explode("hits").alias("hit")).select(
        "row_no", "repo", "owner", "hit.kind_no", "hit.start", "hit.finish",
        F.sha2("hit.value", 256).alias("digest"))
    hits = checkpointed(hits)
    judged = hits.join(ownership(hits), "digest").withColumn(
        "live", (F.col("n_owners") <= owners) & (F.col("n_repos") <= repos))
    spans = judged.where((F.col("kind_no") < len(BASE)) | F.col("live")).groupBy("row_no").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "finish", "live"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind_no:int,finish:int,live:boolean>>")
    return scanned.drop("hits", "repo", "owner").join(spans, "row_no", "left").select(
        "id", *[f"kept_{c}" for c in carry], F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kinds[s["kind_no"]], s["start"].cast("string"), s["finish"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind_no"] < len(BASE))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind))).cast("bigint")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]",
           owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with every reported span replaced by ``mark``.

    Overlapping spans are one redaction.  All columns are kept; a null text stays null.
    """
    columns = docs.columns
    found = scan_secrets(docs, repo_col, text_col, repo_col, owner_col, carry=tuple(columns))
    text = F.col(f"kept_{text_col}")
    ranges = F.aggregate(
        "spans", F.array().cast("array<struct<start:int,finish:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["finish"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["finish"], s["finish"]).alias("finish")))))
        .otherwise(F.concat(acc, F.array(F.struct(
            s["start"].alias("start"), s["finish"].alias("finish"))))))
    cut = F.array_join(F.concat(
        F.transform("ranges", lambda r, i: F.substring(
            text, F.when(i == 0, 1).otherwise(F.get("ranges", i - 1)["finish"] + 1),
            r["start"] - F.when(i == 0, 0).otherwise(F.get("ranges", i - 1)["finish"]))),
        F.array(F.substring(text, F.element_at("ranges", -1)["finish"] + 1,
                            F.lit(2147483647)))), mark)
    clean = F.when(F.size("ranges") > 0, cut).otherwise(text)
    return found.withColumn("ranges", ranges).select(
        *[(clean if c == text_col else F.col(f"kept_{c}")).alias(c) for c in columns])
