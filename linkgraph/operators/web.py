"""Web links into other repositories, judged by what their destinations declare.

Destinations come as a table of fetch results (href, status, body); status -1 stands for a
network error, -2 for a repository that can't be read, -3 for an address that can't be sent.
"""

from __future__ import annotations

import http.client
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgraph.functions import frontmatter, paths, tokens
from linkgraph.operators import documents, splice
from linkgraph.operators.documents import Options, Tree
from linkgraph.plans.cut import cut

# Fixed patterns of addresses.
_BLOB = r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/(?:blob|raw)/([^/]+)/([^#?]+)"
_UNSENDABLE = r"[\x00-\x20\x7f]"
_COMMIT = "^[0-9a-fA-F]{7,40}$"
#: Seconds of a request; attempts of a fetch; statuses that are worth another attempt.
TIMEOUT, ATTEMPTS, TRANSIENT = 15, 3, frozenset({404, 429, 500, 502, 503, 504, -1})
#: Names of environment variables: attempts of a fetch, and the token of the command line.
ATTEMPTS_VARIABLE, TOKEN_VARIABLE = "LINKGRAPH_WEB_ATTEMPTS", "GITHUB_TOKEN"
_API, _RAW, _AGENT = "https://api.github.com/repos", "application/vnd.github.raw", "linkgraph"
PROBLEMS = ("web_mismatch", "web_not_found")


def parsed_url(href: Column) -> Column:
    """struct<owner, repo, ref, path> of an address of a file in a repository; null if it is none."""
    url = paths.stripped(href)
    part = lambda k: F.regexp_extract(url, _BLOB, k)
    fields = F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("ref"), F.regexp_replace(part(4), "/+$", "").alias("path"))
    return F.when(url.rlike(_BLOB) & ~url.rlike(_UNSENDABLE), fields)


def web_links(docs: DataFrame) -> DataFrame:
    """path, s, e, line, text, href, uuid (null for a plain link), exempt, filtered of every web link.

    Documents that opted out are read too; filtered marks their links.
    """
    rows = docs.select("path", (F.col("ignored") | F.col("link_ignored")).alias("filtered"), F.explode("web").alias("l"))
    uuid = F.when(F.col("l.uuid") != "", F.lower("l.uuid"))
    return rows.select("path", *(F.col(f"l.{k}").alias(k) for k in ("s", "e", "line", "text", "href")), uuid.alias("uuid"), (F.col("l.exempt") != "").alias("exempt"), "filtered")


@dataclass(frozen=True)
class WebCheck:
    findings: DataFrame
    edits: DataFrame
    docs: DataFrame

    def rewrites(self) -> DataFrame:
        return splice.rewrites(self.docs, self.edits)

    def verdict(self, own_max: int | None = None) -> DataFrame:
        """anchors, problems, own (missing uuids in owned repositories), code: 4 for problems, 3 for pending anchors, 0.

        Without a budget own_max every missing uuid of an owned destination is a problem.
        """
        counts = self.findings.agg(F.count_if(F.col("kind") == "web_anchor").alias("anchors"), F.count_if(F.col("kind").isin(*PROBLEMS)).alias("problems"), F.count_if(F.col("kind") == "web_own_no_uuid").alias("own"))
        code = F.when((F.col("problems") > 0) | (F.col("own") > (own_max or 0)), 4).when(F.col("anchors") > 0, 3).otherwise(0)
        return counts.withColumn("code", code)


def check(tree: Tree, fetches: DataFrame, options: Options = Options(), owners: tuple[str, ...] = (), have_token: bool = False) -> WebCheck:
    """fetches: href, status, body; links without a fetch count as network errors."""
    docs = documents.prepared(tree, options, ("web",))
    got = fetches.select("href", "status", "body").dropDuplicates(["href"]).withColumn("fm", frontmatter.read_uuid(F.coalesce("body", F.lit(""))))
    got = got.select("href", "status", F.col("fm.status").alias("dest_status"), F.col("fm.uuid").alias("dest_uuid"))
    rows = web_links(docs).withColumn("url", parsed_url(F.col("href"))).join(got, "href", "left").withColumn("status", F.coalesce("status", F.lit(-1)))
    owned = F.lower("url.owner").isin(*[x.lower() for x in owners]) if owners else F.lit(False)
    plain, ok = F.col("uuid").isNull(), F.col("status") == 200
    lacking = plain & owned & F.lower("url.path").endswith(".md") & ~F.col("url.ref").rlike(_COMMIT) & ~F.col("filtered")
    kind = (
        F.when(F.col("url").isNull(), "web_unverifiable")
        .when(F.col("status").isin(401, 403, -2), "web_unverifiable")
        .when(F.col("status") == 404, "web_not_found" if have_token else "web_unverifiable")
        .when(~ok, "web_unverifiable")
        .when(F.col("exempt"), "web_own_exempt")
        .when(plain & F.col("dest_uuid").isNotNull(), "web_anchor")
        .when(plain & owned & (F.col("dest_status") == "invalid"), "web_unverifiable")
        .when(lacking, "web_own_no_uuid")
        .when(plain, "web_unverifiable")
        .when(F.col("dest_uuid").isNull() | (F.col("dest_uuid") != F.col("uuid")), "web_mismatch")
        .otherwise("web_ok")
    )
    helps = F.col("status").isin(401, 403, 404) & F.col("url").isNotNull() & F.lit(not have_token)
    # Findings, verdict and edits all read them.
    rows = cut(rows.withColumn("kind", kind).withColumn("token_would_help", helps))
    detail = F.concat(F.lit("status "), F.col("status").cast("string"), F.lit(", declares "), F.coalesce("dest_uuid", F.lit("no uuid")))
    found = rows.select("path", "line", "href", "kind", "uuid", F.when(F.col("kind") == "web_anchor", F.col("dest_uuid")).alias("anchored"), "token_would_help", detail.alias("detail"), F.col("s").alias("start"))
    edits = rows.where("kind = 'web_anchor' AND NOT filtered").select("path", "s", "e", tokens.web_anchor(F.col("text"), F.col("href"), F.col("dest_uuid")).alias("r"))
    return WebCheck(found, edits, tree.docs)


def _quoted(part: Column, kept: str = "") -> Column:
    """Percent-encoded as UTF-8, but for kept and percent signs: what is encoded already stays as it is."""
    form = F.url_encode(part)
    # url_encode is made for forms: it writes a space as +, keeps *, and encodes ~.
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%25", "%"), *((f"%{ord(x):02X}", x) for x in kept)):
        form = F.replace(form, F.lit(code), F.lit(plain))
    return form


def contents_url(url: Column) -> Column:
    """The address of a file (struct of parsed_url) in the public contents interface."""
    return F.concat(F.lit(f"{_API}/"), _quoted(url["owner"]), F.lit("/"), _quoted(url["repo"]), F.lit("/contents/"), _quoted(url["path"], "/"), F.lit("?ref="), _quoted(url["ref"]))


def repository_url(url: Column) -> Column:
    return F.concat(F.lit(f"{_API}/"), _quoted(url["owner"]), F.lit("/"), _quoted(url["repo"]))


def fetch_once(address: str, token: str | None = None, accept: str = _RAW, opener: Callable = urllib.request.urlopen) -> tuple[int, str | None]:
    """Status and text of one request; -3 for an address that can't be sent, -1 for a network that fails."""
    headers = {"Accept": accept, "User-Agent": _AGENT}
    if token:
        headers["Authorization"] = f"Bearer {token}"
    try:
        with opener(urllib.request.Request(address, headers=headers), timeout=TIMEOUT) as answer:
            return answer.status, answer.read().decode("utf-8-sig", "replace")
    except urllib.error.HTTPError as error:
        return error.code, None
    except Exception as error:
        if isinstance(error, (http.client.InvalidURL, ValueError)):
            return -3, None
        if isinstance(error, (OSError, http.client.HTTPException)):
            return -1, None
        raise


def attempts_of(environment: Mapping[str, str] = os.environ) -> int:
    """ATTEMPTS, unless the environment names a whole number; one at least."""
    named = environment.get(ATTEMPTS_VARIABLE, "").strip()
    return max(1, int(named)) if named.lstrip("-").isdecimal() else ATTEMPTS


def with_retries(once: Callable[[], tuple[int, str | None]], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str | None]:
    """Waits 0.5 s, then twice as long each time, 4 s at most, while the status is transient."""
    for k in range(max(1, attempts)):
        status, body = once()
        if status not in TRANSIENT or k + 1 >= attempts:
            break
        sleep(min(4.0, 0.5 * 2**k))
    return status, body


def fetched(links: DataFrame, token: str | None = None, attempts: int | None = None, once: Callable[..., tuple[int, str | None]] = fetch_once) -> DataFrame:
    """href, status, body of each distinct web link; one fetch for each, on the executors.

    With a token, a file that isn't found counts as such only if its repository can be read, which
    is asked once for each repository; where it can't, the status is -2.
    """
    attempts = attempts_of() if attempts is None else attempts
    urls = links.select("href").distinct().select("href", parsed_url(F.col("href")).alias("u")).where("u IS NOT NULL")
    wanted = urls.select("href", contents_url(F.col("u")).alias("address"), repository_url(F.col("u")).alias("repository"))

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [with_retries(lambda x=x: once(x, token), attempts) for x in batch["address"]]
            yield pd.DataFrame({"href": batch["href"], "repository": batch["repository"], "status": [x[0] for x in got], "body": [x[1] for x in got]})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[once(x, token)[0] in (403, 404) for x in batch["repository"]]]

    # A table of its own: no address is asked for twice.
    rows = cut(wanted.mapInPandas(get, "href string, repository string, status int, body string"))
    if token:
        closed = cut(rows.where("status = 404").select("repository").distinct().mapInPandas(look, "repository string"))
        rows = rows.join(closed.withColumn("closed", F.lit(True)), "repository", "left").withColumn("status", F.when(F.col("closed"), -2).otherwise(F.col("status")))
    return rows.select("href", "status", "body")
