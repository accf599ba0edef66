"""Secret scans with corpus-wide ownership, with DataFrame operations only.

Spans of every whole text: the base kinds assign, access and hex; and two kinds of weaker evidence, short
assigned values ("weak") and vendor-prefixed tokens or key headers ("vendor"). The hash of each value is
counted over the corpus by distinct repositories and owners. A value that COPIED_OWNERS owners have, or that
COPIED_REPOS repositories of more than one owner have, is a widely copied example; one that stays with its
owner, in however many repositories, looks live. Base spans are always reported; weaker ones are reported
where their value looks live. Each span carries the owners and repositories of its value.

The counts go through partial sums by (hash, owner, repository) first, so that a value in a third of all
rows costs one row a task. Null texts are empty; very long texts are scanned whole; a null owner or repository
is one of its own; rows of equal or null ids are apart, repeated rows give repeated rows with equal results;
columns named like the outputs are replaced, and no other name matters; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import let, maybe_among, packed, prefix_sums, staged, unpacked

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "vendor", "weak")
BASE_KINDS = 3
#: A value that so many owners have is a copied example, and one that several owners have in so many repositories.
COPIED_OWNERS, COPIED_REPOS = 3, 4
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Lengths of the gap before each match and of the match, and the group's text; empty without a match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v")
    )
    joined = F.zip_with(
        F.slice(gaps, 1, F.size(gaps) - 1), found,
        lambda g, f: F.struct(g.alias("gap"), F.length(f["m"]).cast("long").alias("len"), f["v"].alias("value"))
    )
    return F.when(text.rlike(pattern), joined)


def _spans(found: str, kind: Column) -> Column:
    """kind: of a value, the rank of its kind, or null to drop the match."""
    at = F.col(f"{found}_at")
    put = F.zip_with(
        found, at,
        lambda f, a: F.struct(
            (a + f["gap"]).alias("start"), kind(f["value"]).cast("int").alias("rank"),
            (a + f["gap"] + f["len"]).alias("end"), f["value"].alias("value")
        )
    )
    return F.coalesce(F.filter(put, lambda s: s["rank"].isNotNull()), F.array().cast(_SPAN))


def candidates(docs: DataFrame, text: str, repo: Column, owner: Column) -> DataFrame:
    """row (docs' columns but text), repo, owner and spans: start, rank of the kind, end and value's hash, by start and kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kinds = {"a": (ASSIGN, 2), "k": (ACCESS, 0), "h": (HEX, 0), "v": (VENDOR, 0)}
    found = packed(docs, repo=repo, owner=owner, **{k: _matches(t, pattern, group) for k, (pattern, group) in kinds.items()})
    found = found.withColumn("row", F.struct(F.lit(1).alias("_"), *[F.col("row").getField(c).alias(c) for c in docs.columns if c != text]))
    # running totals of gap and match give each match's place
    found = found.withColumns({f"{c}_at": F.when(F.col(c).isNotNull(), prefix_sums(F.transform(c, lambda f: f["gap"] + f["len"]))) for c in kinds})
    rank = {k: i for i, k in enumerate(KINDS)}
    assigned = lambda v: F.when(F.length(v) >= 12, rank["assign"]).when(F.length(v) >= 8, rank["weak"])
    spans = F.concat(
        _spans("a", assigned), _spans("k", lambda _: F.lit(rank["access"])),
        _spans("h", lambda _: F.lit(rank["hex"])), _spans("v", lambda _: F.lit(rank["vendor"]))
    )
    hashed = F.transform(F.array_sort(spans), lambda s: F.struct(s["start"], s["rank"], s["end"], F.md5(s["value"]).alias("hash")))
    return found.select("row", "repo", "owner", hashed.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Of each candidate hash: distinct repositories and owners."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = found.select(F.explode(_hashes()).alias("hash"), named("owner").alias("owner"), named("repo").alias("repo"))
    return each.groupBy("hash", "owner", "repo").count().groupBy("hash").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos")
    )


def _hashes() -> Column:
    return F.array_distinct(F.transform("spans", lambda s: s["hash"]))


def scan(
    docs: DataFrame, text: str = "text", repo: str | Column = "source", owner: str | Column = "source",
    copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS
) -> DataFrame:
    """docs without text, with secrets (array of start, end, kind, live, base, owners, repos, by start and kind) and
    n_copied, the spans whose value is a copied example."""
    as_col = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    found = candidates(docs, text, as_col(repo), as_col(owner)).withColumn("uid", F.monotonically_increasing_id())
    found = staged(found, "secrets")
    each = found.select("uid", F.explode(_hashes()).alias("hash"))
    # of each row that has any: the counts of its values, as many as the row has
    entries = F.collect_set(F.struct("hash", F.struct("owners", "repos")))
    known = each.join(ownership(found), "hash").groupBy("uid").agg(F.map_from_entries(entries).alias("counts"))
    marked = found.join(known, "uid", "left")
    kind = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r + 1)

    def verdict(s: Column) -> Column:
        copied = lambda n: (n["owners"] >= copied_owners) | (n["owners"] > 1) & (n["repos"] >= copied_repos)
        return let(F.element_at("counts", s["hash"]), lambda n: F.struct(
            s["start"], s["end"], kind(s["rank"]).alias("kind"), (~copied(n)).alias("live"),
            (s["rank"] < BASE_KINDS).alias("base"), n["owners"].alias("owners"), n["repos"].alias("repos"),
        ))

    judged = marked.withColumn("judged", F.transform("spans", verdict))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, "secrets", "n_copied")]
    return judged.select(
        *others, F.filter("judged", lambda s: s["base"] | s["live"]).alias("secrets"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_copied")
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans replaced by the mark; overlapping spans make one."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    cut = lambda a, b: F.substr(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.concat(cut(acc["at"], s["start"]), F.lit(mark)))).alias("out"))
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    return F.when(
        F.size(spans) > 0,
        F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    ).otherwise(text)


def redacted(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None,
    repo: str | Column = "source", owner: str | Column = "source", mark: str = "[SECRET]"
) -> DataFrame:
    """docs with the spans of their texts replaced by the mark; length names a column that follows the text's. Only rows
    that may hold a secret are shuffled: they meet their spans by id and text's hash. Null texts stay null."""
    as_col = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    own = F.struct(F.col(f"`{key}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))
    keyed = packed(docs, own=own)
    each = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"), as_col(repo).alias("repo"), as_col(owner).alias("owner"))
    found = scan(each, "text", "repo", "owner").where(F.size("secrets") > 0).select("own", "secrets").dropDuplicates(["own"])
    found = staged(found, "spans")
    marked = maybe_among(keyed, "own", found, "own")
    both = marked.where("maybe").drop("maybe").join(found.select(F.col("own").alias("its"), "secrets"), F.col("own").eqNullSafe(F.col("its")), "left")
    clean = F.coalesce("secrets", F.array().cast(both.schema["secrets"].dataType))
    both = both.withColumn("clean", redact(F.col("row").getField(text), clean, mark))
    changed = {text: F.col("clean")}
    if length in docs.columns:
        given = F.col("row").getField(length)
        changed[length] = F.when(F.col("secrets").isNotNull(), F.length("clean").cast(docs.schema[length].dataType)).otherwise(given)
    return unpacked(marked.where("not maybe"), docs.columns).unionAll(unpacked(both, docs.columns, **changed))
