"""Plain links: which can be anchored to a uuid, which point nowhere, and the rewrites that anchor them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions import frontmatter, paths, tokens
from linkgraph.operators import documents, splice
from linkgraph.operators.documents import Options, Tree
from linkgraph.plans.cut import cut

#: Shown in place of a uuid that a plan would give out.
NEW = "(new uuid)"


@dataclass(frozen=True)
class Robustify:
    """findings; edits; created (path, new_content); decisions (target, outcome, uuid); suppressed (path, n); read: the prepared documents."""

    findings: DataFrame
    edits: DataFrame
    created: DataFrame
    decisions: DataFrame
    suppressed: DataFrame
    docs: DataFrame
    read: DataFrame

    def rewrites(self) -> DataFrame:
        return splice.rewrites(self.docs, self.edits).unionByName(self.created)


def plain_links(docs: DataFrame) -> DataFrame:
    """path, s, e, line, text, href, attrs of the plain links that are read."""
    rows = docs.select("path", F.explode("plain").alias("l"))
    return rows.select("path", *(F.col(f"l.{k}").alias(k) for k in ("s", "e", "line", "text", "href", "attrs")))


def detached(docs: DataFrame) -> DataFrame:
    """path, s, e, line, uuid, gap of uuid comments that follow no link."""
    rows = docs.select("path", F.explode("strays").alias("a"))
    return rows.select("path", *(F.col(f"a.{k}").alias(k) for k in ("s", "e", "line", "uuid", "gap")))


def minted(seed: str, path: Column) -> Column:
    """A uuid of version 4's form, the same for the same seed and path; see Options.mint_seed."""
    h = F.sha2(F.concat(F.lit(seed + "\0"), path), 256)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.ascii(part(17, 1)) % 4 + 1).cast("int"), F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def located(links: DataFrame, tree: Tree) -> DataFrame:
    """links with t (what the href names), its type, and the types of its README and of its decoded form."""
    local = paths.is_local_relative(F.col("href"))
    raw = paths.path_part(F.col("href"))
    rows = links.withColumn("local", local).withColumn("of_dir", ~paths.names_md(F.col("href"))).withColumn("t", F.when(local, paths.resolved(F.col("href"), F.col("path"))))
    decoded = paths.percent_decoded(raw)
    rows = rows.withColumn("encoded", decoded != raw).withColumn("decoded", decoded)
    base = F.concat(paths.parent(F.col("path")), F.lit("/"))
    rows = rows.withColumn("d", F.when(F.col("local") & F.col("encoded") & paths.is_local_relative(decoded), paths.normalised(F.concat(base, paths.path_part(decoded)))))
    rows = rows.withColumn("readme", F.when(F.col("local") & F.col("of_dir"), F.when(F.col("t") == ".", F.lit(paths.ANCHOR_NAME)).otherwise(F.concat("t", F.lit("/" + paths.ANCHOR_NAME)))))
    return documents.with_types(cut(rows), ("path", "s"), {"t": "t_type", "readme": "readme_type", "d": "d_type"}, tree)


def plan(tree: Tree, options: Options = Options(), scope: DataFrame | None = None, docs: DataFrame | None = None) -> Robustify:
    """scope: the documents (path) whose links may be rewritten and reported; all are read as targets. docs: prepared already."""
    options = options.seeded()
    docs = cut(documents.prepared(tree, options, ("plain", "strays"))) if docs is None else docs
    links = cut(documents.scoped(located(plain_links(docs), tree), scope))
    planned = cut(_planned_readmes(links, docs, tree, options, scope))
    links = links.join(planned.select(F.col("readme").alias("_new")), F.col("readme") == F.col("_new"), "left")
    file = ~F.col("of_dir") & (F.col("t_type") == "file") & F.lower("t").endswith(".md")
    folder = F.col("of_dir") & (F.col("t_type") == "dir") & ((F.col("readme_type") == "file") | F.col("_new").isNotNull())
    anchor = F.when(F.col("local") & file, F.col("t")).when(F.col("local") & folder, F.col("readme"))
    links = links.withColumn("target", anchor).drop("_new")
    wanted = links.where("target IS NOT NULL AND target <> path")
    decisions = _decisions(wanted.where("scoped").select("target").distinct(), docs, planned, options, scope)
    rows = wanted.where("scoped").join(decisions, "target")
    own = documents.findings
    where = {"line": F.col("line"), "href": F.col("href"), "start": F.col("s")}
    outcomes = rows.where("outcome IN ('out_of_scope', 'deny_listed', 'target_write_refused', 'no_frontmatter')")
    why = F.create_map(*[F.lit(x) for pair in (("out_of_scope", "its target was not read"), ("deny_listed", "its target never gets a uuid"), ("target_write_refused", "its target would have to be written outside the scope"), ("no_frontmatter", "its target has no frontmatter")) for x in pair])
    found = own(outcomes, "strict", F.col("outcome"), F.concat("href", F.lit(": "), why[F.col("outcome")]), **where)
    anchored, edits = _anchored(rows.where("outcome IN ('reuse', 'mint', 'create')"), docs)
    shown = F.when(F.col("outcome") == "reuse", F.col("uuid")).otherwise(F.lit(NEW))
    note = F.when(F.col("moved"), F.lit(" (an anchor on this line is moved to it)")).otherwise(F.lit(""))
    left = F.when(F.col("left") > 0, F.concat(F.lit(" (left on this line: "), F.col("left").cast("string"), F.lit(" anchors with this uuid)"))).otherwise(F.lit(""))
    found = found.unionByName(own(anchored, "strict", "robustify", F.concat("href", F.lit(" +uuid "), shown, note, left), uuid=shown, **where))
    lost = links.where("scoped AND local AND target IS NULL AND t_type IS NULL AND (NOT encoded OR (d IS NOT NULL AND d_type IS NULL))")
    found = found.unionByName(own(lost, "dangling", "dangling", F.concat("href", F.lit(" names "), F.when(F.col("encoded"), F.col("d")).otherwise(F.col("t")), F.lit(", which isn't there")), **where))
    absolute = paths.is_absolute_local(paths.path_part(F.col("href"))) | paths.is_absolute_local(F.col("decoded"))
    found = found.unionByName(own(links.where("scoped AND target IS NULL").where(absolute), "absolute_local_path", "absolute_local_path", F.concat("href", F.lit(" is an absolute path: "), "decoded"), **where))
    found = found.unionByName(own(decisions.where("outcome = 'invalid_frontmatter'").withColumnRenamed("target", "path"), "strict", "invalid_frontmatter", F.lit(documents.INVALID)))
    silent = documents.scoped(docs.where("link_ignored").select("path"), scope).where("scoped")
    found = found.unionByName(own(silent, "strict", "ignored_links", F.lit("its links are left as they are; it is still a target")))
    created = planned.select(F.col("readme").alias("path"), F.concat(F.lit("---\nuuid: "), "uuid", F.lit("\n---\n\n# "), "name", F.lit("\n")).alias("new_content"))
    found = found.unionByName(own(created, "strict", "create_readme", F.lit(f"is created, with {NEW}")))
    minted_docs = decisions.where("outcome = 'mint'").select(F.col("target").alias("path"), "uuid").join(docs.select("path", "head", "has_block", "newline"), "path")
    insertion = frontmatter.uuid_insertion(F.col("head"), F.col("has_block"), F.col("newline"), F.col("uuid"))
    edits = edits.unionByName(minted_docs.select("path", insertion.alias("x")).select("path", "x.s", "x.e", "x.r"))
    if scope is not None:
        outside = documents.scoped(minted_docs.select("path"), scope).where("NOT scoped")
        found = found.unionByName(own(outside, "strict", "target_uuid_write", F.lit("gets a uuid outside the scope, so that a link can be anchored")))
    known = docs.where("NOT ignored AND fm_status = 'valid' AND fm_uuid IS NOT NULL").select(F.col("path").alias("target"))
    suppressed = wanted.where("NOT scoped").join(known, "target", "left_semi").groupBy("path").agg(F.count("*").alias("n"))
    return Robustify(found, edits, created, decisions, suppressed, tree.docs, docs)


def _planned_readmes(links: DataFrame, docs: DataFrame, tree: Tree, options: Options, scope: DataFrame | None) -> DataFrame:
    """readme, uuid, name of the READMEs to be made: one for each directory that a link names and that has none.

    None in a directory with a document that opted out or can't be decoded: it holds foreign content.
    """
    missing = links.where("scoped AND local AND of_dir AND t_type = 'dir' AND readme_type IS NULL").where(~F.col("t").startswith("..") & ~F.col("t").startswith("/"))
    if not options.create_readme:
        missing = missing.where("false")
    missing = missing.where(~paths.within_excluded(F.col("t"), options.all_excludes)).select("t", "readme").distinct()
    if options.deny_globs:
        missing = missing.where(~paths.matches_any(F.lit(paths.ANCHOR_NAME), options.deny_globs))
    foreign = docs.where("ignored").select("path").unionByName(tree.docs.where("content IS NULL").select("path"))
    external = foreign.select(paths.parent(F.col("path")).alias("t")).distinct()
    missing = documents.scoped(missing.join(external, "t", "left_anti"), scope, "wanted", "readme").where("wanted")
    name = F.when(F.col("t") == ".", F.lit(options.root_name)).otherwise(paths.basename(F.col("t")))
    return missing.select("readme", minted(options.mint_seed, F.col("readme")).alias("uuid"), name.alias("name"))


def _decisions(targets: DataFrame, docs: DataFrame, planned: DataFrame, options: Options, scope: DataFrame | None) -> DataFrame:
    """target, outcome, uuid: one decision for each target, however many links name it."""
    known = docs.select(F.col("path").alias("target"), "ignored", "fm_status", "fm_uuid", "has_block")
    rows = targets.join(known, "target", "left").join(planned.select(F.col("readme").alias("target"), F.col("uuid").alias("planned")), "target", "left")
    rows = documents.scoped(rows, scope, "writable", "target")
    outcome = (
        F.when(F.col("planned").isNotNull(), "create")
        .when(F.col("ignored"), "opted_out")
        .when(F.col("fm_status").isNull(), "out_of_scope")
        .when(F.col("fm_status") == "invalid", "invalid_frontmatter")
        .when(F.col("fm_uuid").isNotNull(), "reuse")
        .when(paths.matches_any(paths.basename(F.col("target")), options.deny_globs), "deny_listed")
        .when(~F.col("writable") & F.lit(not options.allow_target_writes), "target_write_refused")
        .when(~F.col("has_block") & F.lit(not (options.create_frontmatter or options.create_readme)), "no_frontmatter")
        .otherwise("mint")
    )
    rows = rows.withColumn("outcome", outcome)
    uuid = F.when(F.col("outcome") == "create", F.col("planned")).when(F.col("outcome") == "reuse", F.col("fm_uuid")).when(F.col("outcome") == "mint", minted(options.mint_seed, F.col("target")))
    return rows.select("target", "outcome", uuid.alias("uuid"))


def _anchored(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to anchor with moved and left (stray anchors), and the edits.

    A stray anchor is moved to a link if it is the only one with its uuid that follows the link
    on its line, and no other link of the line takes that uuid.
    """
    keys = ["path", "line", "uuid"]
    strays = detached(docs).select(*keys, F.struct("s", "e", "gap").alias("a"))
    near = rows.select(*keys, "s", "e").join(strays, keys).groupBy(*keys, "s").agg(F.count("*").alias("here"), F.count_if(F.col("a.s") >= F.col("e")).alias("after"), F.min(F.when(F.col("a.s") >= F.col("e"), F.col("a"))).alias("a"))
    claims = rows.groupBy(*keys).agg(F.count("*").alias("claims"))
    rows = rows.join(near, [*keys, "s"], "left").join(claims, keys)
    moved = F.coalesce((F.col("after") == 1) & (F.col("claims") == 1), F.lit(False))
    rows = rows.withColumn("moved", moved).withColumn("left", F.coalesce("here", F.lit(0)) - F.col("moved").cast("int"))
    edits = rows.select("path", "s", (F.col("e") + F.char_length("attrs")).alias("e"), tokens.robust_link(F.col("text"), F.col("href"), F.col("uuid"), F.col("attrs")).alias("r"))
    gone = rows.where("moved").select("path", (F.col("a.s") - F.col("a.gap")).alias("s"), F.col("a.e").alias("e"), F.lit("").alias("r"))
    return rows, edits.unionByName(gone)
