"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwatch.llm import bpe, contextmix, convtrie, embedjoin, hardneg, htmltext, langid, lshforest, mixing, ngramjoin, toxicity, urls, warc
from cellwatch.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, index, payloads=False).drop("payload")


def op2_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_vertical_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op7_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return lshforest.search(embeddings, lshforest.queries_of(embeddings))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie_of_conversations(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_seekable_warc": op1_seekable_warc,
    "op2_toxic_spans": op2_toxic_spans,
    "op3_html_tree_scoring": op3_html_tree_scoring,
    "op4_url_equivalence": op4_url_equivalence,
    "op5_vertical_ngram_join": op5_vertical_ngram_join,
    "op6_language_bitmasks": op6_language_bitmasks,
    "op7_subspace_pigeonhole": op7_subspace_pigeonhole,
    "op8_hash_prefix_forest": op8_hash_prefix_forest,
    "op9_poisson_mixing": op9_poisson_mixing,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_context_mixing": op13_context_mixing,
}


WARC_SQL = f"""
with rows as (select page_id, url, coalesce(html, '') as html from pages),
digests as (select page_id, url, octet_length(encode(html))::bigint as payload_bytes, sha256(html) as payload_digest from rows),
firsts as (select payload_digest, min(page_id) as first from digests where payload_bytes >= {warc.REVISIT_BYTES} group by 1 having count(*) > 1)
select page_id, payload_bytes, payload_digest, url,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from digests left join firsts using (payload_digest)
"""


def _rule_sql(column: str) -> str:
    """Text or verdict of the longest rule that fits ``host`` and ``path``."""
    cases = " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, column)}'"
        for r in sorted(urls.RULES, key=lambda r: -len(r.text)))
    return f"case {cases} end"


def _ascii_lower_sql(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Only the links that the given pages could have: absolute canonical ones in double quotes.
URL_SQL = rf"""
with recursive parts as (
  select page_id, url, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
split as (select page_id, url, html, coalesce({_ascii_lower_sql("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, regexp_replace(url, '#.*', '') as node from parts),
judged as (select *, {_rule_sql('text')} as rule, {_rule_sql('verdict')} as own from split),
links as (select node as a, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1)) as b from judged where html is not null),
both_ways as (select a, b from links union select b, a from links),
blocked as (select distinct node from judged where own = 'block' and node in (select a from both_ways)
  union select b from blocked join both_ways on a = node)
select page_id, host, path, rule,
  coalesce(own, case when node in (select node from blocked) then 'block' else 'allow' end) as verdict,
  coalesce(node in (select node from blocked), false) as alias_blocked
from judged
"""


#: Components of links between texts: all pairs with a common shingle, then all ids that can be reached.
NGRAM_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_ascii_lower_sql("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= {ngramjoin.SIMILARITY} * (x.n + y.n - n_both)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b),
least as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from least left join sizes using (doc_id)
"""

#: All pairs of usable vectors, then all ids that can be reached.
VECTOR_SQL = f"""
with recursive usable as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from usable),
links as (
  select a.vec_id as a, b.vec_id as b from normed a join normed b on a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {embedjoin.COSINE}),
degrees as (select a as vec_id, count(*) as n from links group by 1),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on links.a = reach.b),
least as (select a as vec_id, min(b) as component_id from reach group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from least left join degrees using (vec_id)
"""


def statements() -> dict[str, str]:
    """SQL of the operators that SQL expresses; the others learn, sample or search, and tests/llm hold them against brute force."""
    return {
        "op1_seekable_warc": WARC_SQL, "op4_url_equivalence": URL_SQL, "op5_vertical_ngram_join": NGRAM_SQL,
        "op7_subspace_pigeonhole": VECTOR_SQL, "op9_poisson_mixing": mixing.oracle_sql(),
        "op11_conversation_trie": convtrie.oracle_sql(),
        "op12_hard_negatives": hardneg.oracle_sql(),
    }
