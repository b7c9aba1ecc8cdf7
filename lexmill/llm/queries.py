"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, embedding_dedup, exact_dedup, html_extract, jaccard, language_id, lexical_search, line_dedup, mixing, pseudonyms, quality, token_store
from .common import shared_dir


#: Not a secret: with real data pass a key of your own to ``pseudonyms.pseudonymised``.
PSEUDONYM_KEY = b"lexmill"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The file of the byte-level BPE vocabulary that the queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"))


def token_digest(docs: DataFrame) -> DataFrame:
    """Write documents to a token store in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id only; repeated rows and rows with a null id have a row each; an empty table gives
    an empty store and result. The store stays, for the result is read from it.
    """
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(docs, to, tokenizer_file())
    return token_store.read_tokens(spark, to, digest=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=4, threshold=85)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(_table(spark, sf_dir, "documents"), tokenizer_file(), str(public_tokenizers.path("piece_bpe_32k.model")))


def queries() -> dict:
    found = (op1_html_extraction, op2_source_mixing, op3_quality_classifier, op4_line_dedup, op5_pseudonyms, op6_token_output, op7_language_id, op8_ngram_jaccard, op9_embedding_dedup, op10_decontamination, op11_lexical_search, op12_exact_dedup, op13_tokenizer_alignment)
    return {f.__name__: f for f in found}


#: Sets of shingles, pairs by shared shingles, closure of the links.
OP8_SQL = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id
from documents left join n using (doc_id) left join (select x as doc_id, min(y) as low from r group by x) using (doc_id)
"""

#: All pairs of a label by cosine in double precision, closure of the links.
OP9_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as l from v),
p as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id where a.l > 0 and b.l > 0 and list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.93),
r(x, y) as (select x, y from p union select r.x, p.y from r join p on r.y = p.x)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join (select x as vec_id, count(*) as n from p group by x) using (vec_id) left join (select x as vec_id, min(y) as low from r group by x) using (vec_id)
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every document scored for every item.
OP11_SQL = f"""
with d as (select doc_id, {_TERMS} as ts from documents), st as (select count(*) filter (where len(ts) > 0) as nd, sum(len(ts))::bigint as nt from d),
q as (select item_id, term, count(*) as r from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, st group by term),
s as (select item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::bigint as score from p join w using (term) join q using (term), st group by all),
t as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank, doc_id, score from t where rank <= 10
"""

#: Groups of equal texts.
OP12_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def oracle_sql() -> dict:
    """SQL can express the exact joins and groups; the other queries are tested by brute force, round trip or held-out accuracy."""
    return {"op8_ngram_jaccard": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_exact_dedup": OP12_SQL}
