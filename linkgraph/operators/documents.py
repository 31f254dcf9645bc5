"""Documents, what exists beside them, and what every analysis needs to know of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.functions import frontmatter, paths, tokens
from linkgraph.plans.cut import cut


@dataclass(frozen=True)
class Options:
    """Options of an analysis.

    excludes: directory names, as globs, that are left out besides the default ones.
    ignore_blocks: names of generated blocks whose links are ignored.
    deny_globs: names of files that never get a uuid.
    marker_prefix: what the names of the opt-out markers begin with, as in ``<!-- PREFIX-ignore-file -->``.
    root_name: the name of the root directory, for a README made there.
    mint_seed: from it and a path comes the uuid that a document is given, so that every evaluation of a plan gives the same; without one, each plan draws its own, so that no two plans give the same uuid.
    """

    excludes: tuple[str, ...] = ()
    ignore_blocks: tuple[str, ...] = ()
    deny_globs: tuple[str, ...] = ()
    create_frontmatter: bool = False
    create_readme: bool = False
    allow_target_writes: bool = True
    marker_prefix: str = "linkgraph"
    root_name: str = "root"
    mint_seed: str | None = None

    @property
    def all_excludes(self) -> tuple[str, ...]:
        return (*paths.DEFAULT_EXCLUDES, *self.excludes)

    def seeded(self) -> Options:
        return self if self.mint_seed is not None else replace(self, mint_seed=uuid4().hex)


@dataclass(frozen=True)
class Tree:
    """docs (path, content) and listing (path, type: file or dir) under one root.

    probe: adds the type of paths that entries can't know, as those outside the root: takes and
    returns (path), (path, type).  outside: links (path) whose targets lie outside the root, which
    are no documents.
    """

    docs: DataFrame
    listing: DataFrame
    probe: Callable[[DataFrame], DataFrame] | None = None
    outside: DataFrame | None = None

    @cached_property
    def entries(self) -> DataFrame:
        """listing, materialised when it is first asked for: every lookup of a target reads it."""
        return cut(self.listing)

    @classmethod
    def of(cls, docs: DataFrame, more: DataFrame | None = None, options: Options = Options()) -> Tree:
        """From any table with path and content; entries are its files with their directories, and more.

        Rows in excluded directories are entries but no documents.
        """
        files = docs.select("path", F.lit("file").alias("type"))
        if more is not None:
            files = files.unionByName(more.select("path", "type"))
        parts = F.split("path", "/")
        above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
        dirs = files.select(F.explode(F.concat(F.array(F.lit(".")), above)).alias("path")).select("path", F.lit("dir").alias("type"))
        listing = files.unionByName(dirs).groupBy("path").agg(F.max("type").alias("type"))
        kept = docs.where(F.lower("path").endswith(".md") & ~paths.within_excluded(paths.parent(F.col("path")), options.all_excludes))
        return cls(kept, listing)


def prepared(tree: Tree, options: Options, kinds: tuple[str, ...] = ("robust", "plain", "strays", "web")) -> DataFrame:
    """What one pass over the contents finds, without the contents; a plan, of which only the columns that are read are computed.

    path; ignored and link_ignored (opt-outs); fm_status, fm_uuid, has_block, head (characters of
    the frontmatter's first line), newline; and of kinds, links and anchors outside code and
    generated blocks, as arrays.  Documents with null content are left out.
    """
    text, code = F.col("content"), F.col("code")
    docs = tree.docs.select("path", "content").where("content IS NOT NULL")
    # A column for each step: what several expressions use is computed once and planned once.
    docs = docs.withColumn("fenced", tokens.fenced_spans(text))
    docs = docs.withColumn("code", F.concat("fenced", tokens.inline_spans(text, F.col("fenced"))))
    docs = docs.withColumn("spans", F.concat(tokens.block_spans(text, options.ignore_blocks), code))
    docs = docs.withColumn("ignored", tokens.carries_marker(text, f"{options.marker_prefix}-ignore-file", code))
    docs = docs.withColumn("link_ignored", ~F.col("ignored") & tokens.carries_marker(text, f"{options.marker_prefix}-ignore-links", code))
    docs = docs.withColumn("fm", frontmatter.read_uuid(text))
    own, spans, found = ~F.col("ignored") & ~F.col("link_ignored"), F.col("spans"), F.col("found")
    scans = {"robust": ("robust",), "plain": ("links",), "strays": ("links", "comments"), "web": ("web",)}
    if kinds:
        docs = docs.withColumn("found", tokens.scan(text, tuple(dict.fromkeys(x for k in kinds for x in scans[k])), options.marker_prefix))
    kept = lambda links: F.when(own, links).otherwise(F.filter(links, lambda m: F.lit(False)))
    make = {"robust": lambda: kept(tokens.robust_links(found, spans)), "plain": lambda: kept(tokens.plain_links(found, spans)), "strays": lambda: kept(tokens.detached_anchors(found, spans)), "web": lambda: tokens.web_links(found, spans)}
    return docs.select(
        "path", "ignored", "link_ignored", F.col("fm.status").alias("fm_status"), F.col("fm.uuid").alias("fm_uuid"),
        frontmatter.has_frontmatter(text).alias("has_block"), frontmatter.head_length(text).alias("head"), frontmatter.newline(text).alias("newline"),
        *(make[k]().alias(k) for k in kinds),
    )


def _identified(docs: DataFrame) -> DataFrame:
    return docs.where("NOT ignored AND fm_status = 'valid' AND fm_uuid IS NOT NULL").select(F.col("fm_uuid").alias("uuid"), "path")


def uuid_index(docs: DataFrame) -> DataFrame:
    """uuid, n, path (the first); n > 1 means that the uuid is ambiguous."""
    return _identified(docs).groupBy("uuid").agg(F.count("*").alias("n"), F.min("path").alias("path"))


def duplicate_uuids(docs: DataFrame) -> DataFrame:
    """uuid, path of every document that shares its uuid, a row each: a group may be of any size."""
    own = cut(_identified(docs))
    return own.join(own.groupBy("uuid").count().where("count > 1").select("uuid"), "uuid", "left_semi")


#: What findings say of a document whose frontmatter can't be read.
INVALID = "its frontmatter is no valid YAML"


def invalid_documents(docs: DataFrame) -> DataFrame:
    return docs.where("NOT ignored AND fm_status = 'invalid'").select("path")


def with_type(rows: DataFrame, column: str, out: str, tree: Tree) -> DataFrame:
    """rows with the type of the entry at column, null if there is none; hot targets are left to adaptive execution."""
    known = tree.entries.select(F.col("path").alias("_path"), F.col("type").alias(out))
    if tree.probe is not None:
        outside = rows.where(F.col(column).startswith("..") | F.col(column).startswith("/")).select(F.col(column).alias("path")).distinct()
        known = known.unionByName(tree.probe(outside).select(F.col("path").alias("_path"), F.col("type").alias(out)))
    return rows.join(known, F.col(column) == F.col("_path"), "left").drop("_path")


def with_types(rows: DataFrame, keys: tuple[str, ...], wanted: dict[str, str], tree: Tree) -> DataFrame:
    """rows, which keys tell apart, with the types of the entries at several columns (column: out).

    One lookup for all of them, of the targets that aren't null only.
    """
    each = F.array(*(F.struct(F.lit(out).alias("out"), F.col(column).alias("at")) for column, out in wanted.items()))
    asked = rows.select(*keys, F.explode(F.filter(each, lambda x: x["at"].isNotNull())).alias("x")).select(*keys, "x.out", "x.at")
    found = with_type(asked, "at", "type", tree).where("type IS NOT NULL")
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("out") == out, F.col("type"))).alias(out) for out in wanted.values()))
    return rows.join(found, list(keys), "left")


def scoped(rows: DataFrame, scope: DataFrame | None, out: str = "scoped", column: str = "path") -> DataFrame:
    """rows with whether the path is in scope (path); everything is without a scope."""
    if scope is None:
        return rows.withColumn(out, F.lit(True))
    named = scope.select(F.col("path").alias("_scope")).distinct()
    return rows.join(named, F.col(column) == F.col("_scope"), "left").withColumn(out, F.col("_scope").isNotNull()).drop("_scope")


FINDING = ("axis", "kind", "path", "line", "href", "uuid", "detail", "start")


def findings(rows: DataFrame, axis: str, kind, detail, **known) -> DataFrame:
    """Rows of the common shape of findings; known: columns that aren't null."""
    kinds = {"line": "int", "href": "string", "uuid": "string", "start": "int"}
    columns = [(known[k] if k in known else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return rows.select(F.lit(axis).alias("axis"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col("path"), *columns, detail.alias("detail")).select(*FINDING)
