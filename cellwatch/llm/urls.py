"""URL verdicts from rules and from redirect equivalence.

A rule is a host, a path and a verdict; it fits the host and all its subdomains where
the url's path starts with the rule's, and the longest that fits wins.  Redirects and
canonical links make urls aliases of each other: the connected components over those
links carry block decisions from any member to members without a rule of their own.  A
url that a rule allows stays allowed whatever its aliases are; a url without a rule
and without a blocked alias is allowed.

Links come from the pages (``<link rel=canonical>`` in the head and ``<meta http-equiv=refresh>``
anywhere; tags in comments, scripts and other raw text are none) and, where given, from a table of crawled redirects.  A node is a url with its
scheme and host in lower case and without its fragment.

Defined results: a null url, or one without ``://``, has an empty host and path, fits
no rule, has no aliases and is allowed; a null html has no links; repeated rows and
repeated page ids give a row each; empty tables give empty results.  Rules are a
parameter of the plan and thus a short list; ``MOST_RULES`` bounds it.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from cellwatch.llm.components import components

MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(*lines: str) -> list[Rule]:
    """Rules from lines like ``block example.org/es/``."""
    found = []
    for line in lines:
        verdict, text = line.split(" ", 1)
        host, slash, path = text.partition("/")
        found.append(Rule(verdict, host, slash + path))
    return found


RULES = rules("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The url as a node of the link graph; null where it has no ``://``."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host(url), F.when(rest == "", "/").otherwise(rest))


def fitting_rule(host: Column, path: Column, among: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls; of equal ones, an allowing one."""
    if len(among) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(among, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


#: A tag's attribute value: double, single or no quotes.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


#: A comment, an element of raw text, or a tag with its quoted values; what never ends goes to the page's end.
_TOKEN = (
    r"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|<(script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
    r"""|</?[a-z](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+(?:>|\z)""")


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"'/]{name}{_VALUE}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _resolved(found: DataFrame) -> DataFrame:
    """``src`` and ``dst`` nodes of link targets ``target`` on pages ``url``; step by step, so that no expression repeats."""
    target = F.col("target")
    steps = found.select(
        "url", F.regexp_replace(F.trim("target"), "&(amp|#38|#x26);", "&").alias("target"),
        F.substring_index("url", "://", 1).alias("scheme"), host(F.col("url")).alias("site"), path(F.col("url")).alias("path"))
    steps = steps.withColumn("site", F.concat("scheme", F.lit("://"), "site")).withColumn(
        "folder", F.regexp_extract("path", r"^(.*/)", 1))
    whole = (
        F.when(target == "", None).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.col("scheme"), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(F.col("site"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(target.startswith("?") | target.startswith("#"), F.concat(F.col("site"), F.col("path"), target))
        .otherwise(F.concat(F.col("site"), F.when(F.col("folder") == "", "/").otherwise(F.col("folder")), target))
    )
    return steps.select("url", whole.alias("target")).select(node(F.col("url")).alias("src"), node(F.col("target")).alias("dst"))


def page_links(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` nodes of canonical links in the heads and refresh redirects of pages."""
    tokens = F.filter(F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0)), lambda t: t.rlike(r"(?i)^<(?:link|meta|body|/head)[\s/>]"))
    found = pages.where("url is not null and html is not null").select("url", tokens.alias("tokens"))
    ends = F.array_position(F.transform("tokens", lambda t: t.rlike(r"(?i)^<(?:body|/head)")), True)
    tags = found.select("url", ends.alias("end"), F.posexplode("tokens").alias("at", "tag"))
    tag = F.col("tag")
    parts = tags.select(
        "url", ((F.col("end") == 0) | (F.col("at") + 1 < F.col("end"))).alias("in_head"), F.lower(F.substring("tag", 2, 4)).alias("kind"),
        *[_attribute(tag, name).alias(name) for name in ("rel", "href", "http-equiv", "content")])
    canonical = F.when(F.col("in_head") & (F.col("kind") == "link") & F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), F.col("href"))
    refresh = F.when(
        (F.col("kind") == "meta") & (F.lower("http-equiv") == "refresh"),
        F.regexp_extract("content", r"(?i)url\s*=\s*[\"']?([^\"']*)", 1))
    found = _resolved(parts.select("url", F.coalesce(canonical, refresh).alias("target")).where("target is not null"))
    return found.where("src is not null and dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, among: list[Rule] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page, and ``alias_blocked``: an alias is blocked by a rule.

    ``redirects``: columns ``src`` and ``dst``, urls.
    """
    among = RULES if among is None else among
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst")))
    members = components(links)
    _, ruled = fitting_rule(host(F.col("node")), path(F.col("node")), among)
    blocked = members.where(ruled == "block").select("component").distinct()
    aliases = members.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    url = F.col("url")
    text, verdict = fitting_rule(F.col("host"), F.col("path"), among)
    judged = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), node(url).alias("node"))
    judged = judged.withColumn("rule", text).withColumn("own", verdict)
    judged = judged.join(aliases, "node", "left").withColumn("alias_blocked", F.coalesce("alias_blocked", F.lit(False)))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"), "alias_blocked")
