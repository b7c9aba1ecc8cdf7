"""All registered queries of the retrieval jobs; their DuckDB equivalents are in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params, schemas
from ..functions import questions as Q
from ..functions import text as X
from ..operators import chunks as K
from ..operators import dense as D
from ..operators import evaluation as E
from ..operators import grounding as G
from ..operators import index as I
from ..operators import lexical as L
from ..operators import pages as P
from ..operators import quality as A
from ..operators import retrieval as R
from ..operators import scoring as B
from ..operators import segments as S
from ..sources import f16, io, snapshot
from ..streaming.questions import plan_stream, with_history
from ..streaming.rate_limit import rate_limit as limit_rows
from ..streaming.rate_limit import rate_limit_stream as limit_stream
from .oracle import ORACLE  # noqa: F401
from ..operators.carry import numbered
from .overlay import NUMBERED, VIEWS
from .sizes import small
from .stages import scratch, stage

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``overlay`` over the tables of a folder."""
    if name == "pages_view":
        raw = table(spark, sf_dir, "documents").select(F.col("source").alias("book_file"), "text", "doc_id")
        return spark.sql(VIEWS[name].replace(NUMBERED, "{src}"), src=io.number_pages(raw, ["doc_id"]))
    source = "conversations" if name in ("questions_view", "answers_view", "expected_view", "second_view") else "documents"
    return spark.sql(VIEWS[name].replace(f"from {source}", "from {src}"), src=table(spark, sf_dir, source))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks in the chunk schema's columns."""
    c = view(spark, sf_dir, "chunks_view")
    none = F.array().cast("array<string>")
    c = c.withColumns({"article_numbers": F.when(F.col("article").isNotNull(), F.array("article")).otherwise(none), "mentions": X.mentions(F.col("text")), "chapter": F.lit(None).cast("string"), "printed_page": F.lit(None).cast("int")})
    return c.withColumn("search_text", F.concat(K.context_line(), F.lit("\n"), F.col("text")))


def benchmark_questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def documents_as_chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def joined(c, sep=" "):
    return F.array_join(c, sep)


# --- pages -------------------------------------------------------------------------------------


@query
def line_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", "n", X.line_key(F.col("line")).alias("key"))


@query
def repeating_lines(spark, sf_dir):
    return P.repeating_lines(view(spark, sf_dir, "pages_view"), 0.1)


@query
def clean_pages(spark, sf_dir):
    return P.clean_pages(view(spark, sf_dir, "pages_view"), 0.1)


@query
def page_filter(spark, sf_dir):
    return P.page_filter(P.clean_pages(view(spark, sf_dir, "pages_view"), 0.1)).select("book_file", "pdf_page", "useful", "devanagari", "kept")


@query
def book_preview(spark, sf_dir):
    return P.preview(view(spark, sf_dir, "pages_view"))


@query
def book_registry(spark, sf_dir):
    """Included books with pages, and those without any."""
    books = view(spark, sf_dir, "books_view")
    pages = view(spark, sf_dir, "pages_view")
    have, lack = io.included_books(books, pages)
    return have.select("file", "title", F.lit("ok").alias("status")).unionByName(lack.select("file", "title", F.lit("missing").alias("status")))


# --- segments and chunks -------------------------------------------------------------------------


@query
def toc_pages(spark, sf_dir):
    pages = view(spark, sf_dir, "pages_view")
    return pages.select("book_file", "pdf_page", S.is_toc_page(F.col("text")).alias("toc"))


@query
def line_markers(spark, sf_dir):
    """Events of all books by kind: parts, pending titles, chapters, schedules, articles, contents."""
    pages = P.page_filter(P.clean_pages(view(spark, sf_dir, "pages_view"), 0.1)).where("kept")
    return S.mark_lines(pages, view(spark, sf_dir, "books_view")).groupBy("book_file", "kind").agg(F.count("*").alias("n"))


@query
def segments(spark, sf_dir):
    pages = P.page_filter(P.clean_pages(view(spark, sf_dir, "pages_view"), 0.1)).where("kept")
    return S.segment(pages, view(spark, sf_dir, "books_view"))


@query
def chunk_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(K.pieces(F.col("text"))).alias("n", "piece"))


@query
def chunk_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("text").alias("section_type"))
    return K.split_segments(docs)


@query
def chunk_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("book_file"), "doc_id", "text")
    return K.drop_repeats(docs, ["doc_id"]).select("doc_id")


@query
def chunk_ids(spark, sf_dir):
    c = view(spark, sf_dir, "chunks_view").select("book_file", F.col("id").alias("old"))
    return K.number_chunks(c, view(spark, sf_dir, "books_view"), ["old"]).select("old", "id")


@query
def article_mentions(spark, sf_dir):
    return view(spark, sf_dir, "chunks_view").select("id", joined(X.mentions(F.col("text")), ",").alias("mentions"))


@query
def search_text(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("id", "search_text")


@query
def chunk_build(spark, sf_dir):
    out = K.build_chunks(view(spark, sf_dir, "pages_view"), view(spark, sf_dir, "books_view"), 0.1)
    return out.withColumns({"article_numbers": joined(F.col("article_numbers"), ","), "mentions": joined(F.col("mentions"), ",")})


@query
def book_stats(spark, sf_dir):
    pages = view(spark, sf_dir, "pages_view")
    filtered = P.page_filter(P.clean_pages(pages, 0.1))
    return A.book_stats(filtered, view(spark, sf_dir, "chunks_view"))


@query
def quality_report(spark, sf_dir):
    return A.quality_report(chunk_table(spark, sf_dir))


@query
def junk_chunks(spark, sf_dir):
    return chunk_table(spark, sf_dir).where(A.is_junk()).select("id")


@query
def chunk_sample(spark, sf_dir):
    return A.sample_chunks(chunk_table(spark, sf_dir)).select("id")


@query
def article_index(spark, sf_dir):
    return A.article_index(chunk_table(spark, sf_dir)).select("article", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query
def key_check(spark, sf_dir):
    return A.key_check(chunk_table(spark, sf_dir))


@query
def manifest(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    stats = A.book_stats(P.page_filter(P.clean_pages(view(spark, sf_dir, "pages_view"), 0.1)), view(spark, sf_dir, "chunks_view"))
    m = io.manifest(c, stats, "model", 64)
    total = lambda name: F.aggregate("books", F.lit(0).cast("long"), lambda a, b: a + b[name])
    return m.select("count", "articles_indexed", "embedding_model", "dim", F.size("books").alias("n_books"), total("chunks").alias("book_chunks"), total("pages").alias("pages"), total("pages_dropped").alias("pages_dropped"))


# --- lexical -------------------------------------------------------------------------------------


@query
def tokenise(spark, sf_dir):
    toks = X.tokens(F.col("text"), True)
    return table(spark, sf_dir, "documents").select("doc_id", joined(toks).alias("tokens"), F.size(toks).alias("n_tokens"))


@query
def bm25_index(spark, sf_dir):
    return L.postings_counted(documents_as_chunks(spark, sf_dir))


@query
def bm25_idf(spark, sf_dir):
    post, stats = L.index(documents_as_chunks(spark, sf_dir))
    return L.document_frequency(post).crossJoin(F.broadcast(stats)).select("term", "df", F.round(L.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query
def bm25_topk(spark, sf_dir):
    post, stats = L.index(documents_as_chunks(spark, sf_dir))
    found = L.search(benchmark_questions(spark, sf_dir), post, stats)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query
def bm25_bounded(spark, sf_dir):
    """Benchmark items against a stored index of the chunks; the rows of ``lexical.bounded``, by blocks, which leave no posting out and take less time."""
    index = I.write_index(chunk_table(spark, sf_dir), scratch(spark, "index"))
    asked = stage(L.query_terms(benchmark_questions(spark, sf_dir)))
    terms = L.weighted_terms(asked, index.frequencies(stage(asked.select("term").distinct())), index.stats)
    return B.scored(terms, index).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_ideal(spark, sf_dir):
    found = L.ideal_score(benchmark_questions(spark, sf_dir), *L.index(documents_as_chunks(spark, sf_dir)))
    return found.select("query_id", F.round("ideal", 6).alias("ideal"))


@query
def query_coverage(spark, sf_dir):
    """Coverage of each turn's text by the turn before it in the conversation."""
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.where("before is not null").select("conv_id", "turn", F.round(X.coverage(X.tokens(F.col("text")), X.tokens(F.col("before"))), 6).alias("coverage"))


@query
def token_jaccard(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.where("before is not null").select("conv_id", "turn", F.round(X.jaccard(X.tokens(F.col("text")), X.tokens(F.col("before"))), 6).alias("jaccard"))


# --- dense ---------------------------------------------------------------------------------------


@query
def l2_normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", D.l2_normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query
def mean_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return D.mean_pool(rows, 64).select("id", F.posexplode("vector").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


@query
def dense_topk(spark, sf_dir):
    """The best 30 vectors for every twentieth one."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = D.dense_topk(queries, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")))
    return found.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


@query
def attach_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return D.attach_vectors(c, e, 64).select("id", "mode", F.col("vector").isNotNull().alias("has_vector"))


# --- questions -----------------------------------------------------------------------------------


@query
def sanitise_questions(spark, sf_dir):
    return view(spark, sf_dir, "questions_view").select("query_id", Q.sanitise(F.col("question")).alias("question"))


@query
def extract_articles(spark, sf_dir):
    return view(spark, sf_dir, "questions_view").select("query_id", joined(Q.extract_articles(F.col("question")), ",").alias("articles"))


@query
def expand_questions(spark, sf_dir):
    expanded, hints = Q.expand(F.col("question"))
    return view(spark, sf_dir, "questions_view").select("query_id", expanded.alias("expanded"), joined(hints, ",").alias("hints"))


@query
def question_intent(spark, sf_dir):
    return view(spark, sf_dir, "questions_view").select("query_id", Q.intent(F.col("question")).alias("intent"), Q.is_pure_article(F.col("question")).alias("pure"))


@query
def article_keys(spark, sf_dir):
    return view(spark, sf_dir, "chunks_view").where("article is not null").select("id", Q.article_key(F.concat(F.lit(" "), F.lower("article"), F.lit(" "))).alias("key"))


@query
def follow_up(spark, sf_dir):
    """Every user turn, rewritten in the light of the turns before it."""
    q = view(spark, sf_dir, "questions_view").select("conv_id", "turn", "question")
    t = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").join(q, ["conv_id", "turn"], "left")
    content = F.coalesce("question", F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    t = t.withColumn("history", F.collect_list(F.struct("role", content.alias("content"))).over(before))
    return t.where("role = 'user'").select("conv_id", "turn", Q.follow_up(content, F.col("history")).alias("question"))


@query
def validate_requests(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    history = F.array(F.struct("role", F.col("text").alias("content")), F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content")))
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text")).alias("question"), history.alias("history"))
    got = io.validate_requests(rows)
    return got.select("query_id", F.length("question").alias("n_chars"), F.size("history").alias("n_turns"), "reason")


# --- retrieval -----------------------------------------------------------------------------------


def _asked(spark, sf_dir):
    q = view(spark, sf_dir, "questions_view").select("query_id", Q.sanitise(F.col("question")).alias("question"))
    return R.understand(q)


def _postings_of(asked, spark, sf_dir, column):
    """Articles of the questions' numbers only, the first few chunks of each."""
    named = asked.select(F.explode(column).alias("article")).select(Q.article_key("article").alias("article")).distinct()
    return A.article_postings(chunk_table(spark, sf_dir), small(named, 200_000), params.PINNED_PER_ARTICLE)


@query
def article_lookup(spark, sf_dir):
    """Chunks of the articles that questions name."""
    rows = _asked(spark, sf_dir).select("query_id", F.explode("articles").alias("article"))
    named = small(rows.select(Q.article_key("article").alias("article")).distinct(), 200_000)
    return R.lookup_all(rows, A.article_postings(chunk_table(spark, sf_dir), named)).select("query_id", "article", "chunk_id", "pos")


@query
def pinned_chunks(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return R.pinned(asked, _postings_of(asked, spark, sf_dir, "articles"))


@query
def hint_chunks(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return R.hinted(asked, _postings_of(asked, spark, sf_dir, "hints"))


def _vectors(spark, sf_dir):
    """(question vectors, chunk vectors): every twentieth vector is that of a question, all are those of the documents by id."""
    e = stage(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")))
    return e.where("chunk_id % 20 = 0").select((F.col("chunk_id") / 20).cast("long").alias("query_id"), "vector"), e


def _ranked_lists(spark, sf_dir):
    """The lexical and the dense list of each benchmark item."""
    post, stats = L.index(documents_as_chunks(spark, sf_dir))
    asked = benchmark_questions(spark, sf_dir)
    queries, vectors = _vectors(spark, sf_dir)
    dense = D.dense_topk(queries.join(asked.select("query_id"), "query_id", "left_semi"), vectors)
    return stage(L.search(asked, post, stats)).select("query_id", "chunk_id", "rank"), dense.select("query_id", "chunk_id", "rank")


@query
def rank_fusion(spark, sf_dir):
    lex, other = _ranked_lists(spark, sf_dir)
    return R.fuse([lex, other]).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "first_list", "first_rank")


@query
def rerank_questions(spark, sf_dir):
    lex, other = _ranked_lists(spark, sf_dir)
    asked = benchmark_questions(spark, sf_dir).withColumn("expanded", F.col("question"))
    fused = stage(R.fuse([lex, other]))
    return R.rerank(fused, asked, R.words_of(documents_as_chunks(spark, sf_dir), fused, "text")).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _turns(spark, sf_dir):
    """(conv_id, turn, role, content, query_id) of all turns; questions that stand alone are conversations of their own."""
    q = view(spark, sf_dir, "questions_view").select("query_id", "conv_id", "turn", "question")
    t = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").join(q, ["conv_id", "turn"], "left")
    t = t.select("conv_id", "turn", "role", F.coalesce("question", F.col("text")).alias("content"), "query_id")
    alone = q.where("query_id < 0").select(F.col("query_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content"), "query_id")
    return t.unionByName(alone)


def _questions(spark, sf_dir):
    """Questions of the view with the turns before them."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    t = _turns(spark, sf_dir).withColumn("history", F.collect_list(F.struct("role", "content")).over(before))
    return t.where("query_id is not null").select("query_id", F.col("content").alias("question"), "history")


def _retrieved(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    planned, selected = R.retrieve(_questions(spark, sf_dir), I.write_index(c, scratch(spark, "index")))
    return stage(planned.withColumn("kind", R.plan_kind()).withColumn("reason", R.plan_reason())), selected, c


@query
def index_merge(spark, sf_dir):
    """Postings of an index that was built of drafts of three quarters of the chunks and then given the chunks as they are.

    Some chunks are new to the merge, some differ from their draft, most are as they were, and one that is no chunk any more goes.
    """
    path, c = scratch(spark, "index"), chunk_table(spark, sf_dir)
    draft = c.where("id % 4 <> 3").withColumn("search_text", F.when(F.col("id") % 4 == 2, F.concat(F.lit("Draft of old words. "), "search_text")).otherwise(F.col("search_text")))
    gone = draft.limit(1).withColumn("id", F.lit(-1).cast("long"))
    I.write_index(draft.unionByName(gone), path)
    merged = I.merge(I.open_index(spark, path), c, removed=spark.createDataFrame([(-1,)], "chunk_id long"))
    return merged.postings()


@query
def index_versions(spark, sf_dir):
    """Counts of an index after a build, a merge of the same chunks without every fifth, and a compaction; the first is still readable."""
    path, c = scratch(spark, "index"), chunk_table(spark, sf_dir)
    first = I.write_index(c, path)
    second = I.merge(first, c, removed=c.where("id % 5 = 0").select(F.col("id").alias("chunk_id")))
    third = I.compact(second)
    out = None
    for v in (first.version, second.version, third.version):
        at = I.open_index(spark, path, v)
        terms = at.postings().agg(F.countDistinct("term").alias("terms"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
        row = terms.crossJoin(F.broadcast(at.stats)).select(F.lit(v).alias("version"), "n", F.round("avgdl", 6).alias("avgdl"), "terms", "tokens")
        out = row if out is None else out.unionByName(row)
    return out


@query
def diverse_selection(spark, sf_dir):
    _, selected, _ = _retrieved(spark, sf_dir)
    return selected.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "pinned", "n")


@query
def question_plans(spark, sf_dir):
    planned, _, _ = _retrieved(spark, sf_dir)
    return planned.drop("history").withColumn("articles", joined(F.col("articles"), ","))


def _vectors_of_all(spark, sf_dir):
    """Question vectors as in ``_vectors``; every document's vector is that of its id modulo the number of vectors."""
    queries, e = _vectors(spark, sf_dir)
    n = e.agg(F.count("*").alias("vectors"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).crossJoin(F.broadcast(n))
    return queries, d.select("id", (F.col("id") % F.col("vectors")).alias("chunk_id")).join(e, "chunk_id").select(F.col("id").alias("chunk_id"), "vector")


@query
def hybrid_plans(spark, sf_dir):
    """Benchmark items planned over an index with a vector for each chunk; items without a vector are planned by words alone."""
    planned, _ = R.retrieve(benchmark_questions(spark, sf_dir), chunk_table(spark, sf_dir), *_vectors_of_all(spark, sf_dir))
    return planned.withColumn("kind", R.plan_kind()).withColumn("reason", R.plan_reason()).withColumn("articles", joined(F.col("articles"), ","))


@query
def source_citations(spark, sf_dir):
    planned, selected, c = _retrieved(spark, sf_dir)
    return R.sources(planned, selected, c)


@query
def context_blocks(spark, sf_dir):
    """Passages of a fixed selection: the first three chunks of each article."""
    c = chunk_table(spark, sf_dir)
    post = A.article_postings(c).where("pos < 3")
    sel = post.select(F.regexp_replace("article", "[^0-9]", "").cast("long").alias("query_id"), "chunk_id")
    sel = sel.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")).alias("n"))
    return R.context_blocks(sel, c)


@query
def prompt_messages(spark, sf_dir):
    planned, selected, c = _retrieved(spark, sf_dir)
    m = R.prompts(planned, R.context_blocks(selected, c), "Answer from the context only.", "Quote the article.")
    turns = F.transform("messages", lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["content"], F.lit(""))))
    return m.select("query_id", F.size("messages").alias("n_messages"), F.array_join(turns, "\x1e").alias("messages"))


@query
def answer_log(spark, sf_dir):
    planned, selected, _ = _retrieved(spark, sf_dir)
    out = io.answer_log(planned, selected, calls=_called(planned, selected))
    return out.withColumns({"articles": joined(F.col("articles"), ","), "chunks": F.array_join(F.transform("chunks", lambda i: i.cast("string")), ",")})


@query
def question_stream(spark, sf_dir):
    """Turns that arrive in three runs of a stream, each with the turns before it from the state, planned against a stored index; their log."""
    folder, key = scratch(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    I.write_index(chunk_table(spark, sf_dir), f"{folder}/index")
    t = stage(_turns(spark, sf_dir))
    last = t.agg(F.max("turn").alias("last"))
    t = stage(t.crossJoin(F.broadcast(last)).withColumn("run", F.expr("turn * 3 div (last + 1)")).drop("last"))
    kept = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for run in range(3):
            t.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema("conv_id long, turn long, role string, content string, query_id long").parquet(f"{folder}/in")
            plan_stream(with_history(source), f"{folder}/index", f"{folder}/log", f"{folder}/state", _called).awaitTermination()
    finally:
        spark.conf.set(key, kept) if kept else spark.conf.unset(key)
    log = "query_id long, q string, articles array<string>, confidence string, mode string, chunks array<string>, model string, ms long, kind string, batch int"
    got = spark.read.schema(log).json(f"{folder}/log")
    return got.select("query_id", "q", joined(F.col("articles"), ",").alias("articles"), "confidence", "mode", joined(F.col("chunks"), ",").alias("chunks"), "model", "ms", "kind")


def _called(planned, selected):
    """What stands for a call of a model."""
    return planned.select("query_id", F.lit("model").alias("model"), F.abs(F.col("query_id") % 1000).alias("ms"))


def _outcomes(spark, sf_dir):
    planned, selected, c = _retrieved(spark, sf_dir)
    words = lambda col: F.filter(F.split(col, ","), lambda w: w != "")
    expected = view(spark, sf_dir, "expected_view").select("query_id", words("articles").alias("articles"), words("keywords").alias("keywords"), "refuse")
    context = stage(G.context_of(selected, c))
    return stage(E.outcomes(expected, planned, context)), planned, context


@query
def outcomes(spark, sf_dir):
    """Outcome and report line of each question with expectations: articles or keywords to be found, or a refusal."""
    results, planned, _ = _outcomes(spark, sf_dir)
    return results.join(E.report_lines(results, planned), "query_id")


@query
def evaluation(spark, sf_dir):
    """Hit rate, refusal accuracy, and the share of the answered positives whose answer, the turn after the question, is not grounded."""
    results, _, context = _outcomes(spark, sf_dir)
    answers = view(spark, sf_dir, "answers_view").select((F.col("query_id") - 1).alias("query_id"), "answer")
    return E.metrics(results, G.check_grounding(answers, context))


# --- files ---------------------------------------------------------------------------------------


@query
def page_numbers(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.col("source").alias("book_file"), "text", "doc_id")
    return io.number_pages(raw, ["doc_id"]).select("book_file", "pdf_page", F.md5("text").alias("digest"))


@query
def chunk_files(spark, sf_dir):
    """Chunks written as JSON lines by book and read back."""
    folder = scratch(spark, "chunks")
    io.write_chunks(chunk_table(spark, sf_dir).select(*[c.split()[0] for c in schemas.CHUNK.split(", ")]), folder)
    got = io.read_chunks(spark, folder)
    return got.select("id", "book_file", "pdf_page", "part", F.get("article_numbers", F.lit(0)).alias("article"), joined(F.col("mentions"), ",").alias("mentions"), "section_type", F.md5("search_text").alias("digest"))


@query
def article_index_file(spark, sf_dir):
    """The article index written and read back as postings."""
    folder = scratch(spark, "index")
    io.write_article_index(A.article_index(chunk_table(spark, sf_dir)), folder)
    return io.read_article_index(spark, folder)


def _published(spark, sf_dir):
    root = scratch(spark, "corpus")
    filtered = P.page_filter(P.clean_pages(view(spark, sf_dir, "pages_view"), 0.1))
    chunks = chunk_table(spark, sf_dir).select(*[c.split()[0] for c in schemas.CHUNK.split(", ")])
    return root, snapshot.publish(chunks, filtered, root, "model", 64, most=1.0)


@query
def published_quality(spark, sf_dir):
    """The quality report of a published build, observed while its chunks were written."""
    root, _ = _published(spark, sf_dir)
    return snapshot.manifests(spark, root).select("quality.*")


@query
def published_books(spark, sf_dir):
    """Books of the manifest of a published build, which its readers resolve, with the articles that its index holds."""
    root, _ = _published(spark, sf_dir)
    held = snapshot.articles_of(spark, root).join(snapshot.chunks_of(spark, root).select(F.col("id").alias("chunk_id"), "book_file"), "chunk_id").groupBy("book_file").agg(F.countDistinct("article").alias("articles"))
    books = snapshot.manifests(spark, root).select(F.explode("books").alias("b")).select(F.col("b.file").alias("book_file"), "b.pages", "b.pages_dropped", "b.chunks")
    return books.join(held, "book_file", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


@query
def vector_file(spark, sf_dir):
    """The vectors as a flat float16 matrix in order of their ids, written and read back in byte ranges."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", F.col("embedding").alias("vector"), F.lit(0).alias("all"))
    rows = stage(numbered(e, "all", ["vec_id"], "n").select("vec_id", (F.col("n") - 1).alias("chunk_id"), "vector"))
    folder, dim = scratch(spark, "vectors"), rows.select(F.size("vector")).first()[0]
    f16.write_f16(rows, folder, dim)
    got = f16.read_f16(spark, folder, rows.count(), dim)
    return rows.select("vec_id", "chunk_id").join(got, "chunk_id").select("vec_id", F.posexplode("vector").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))


@query
def index_health(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    none = c.groupBy("book_file").agg(F.count("*").alias("chunks"), F.lit(0).alias("pages"), F.lit(0).alias("pages_dropped"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector"))
    return io.health(io.manifest(c, none, "model", 64), c, vectors, 64)


# --- grounding -----------------------------------------------------------------------------------


@query
def citation_check(spark, sf_dir):
    text, invalid = G.citations(F.col("answer"), F.col("n_sources"))
    return view(spark, sf_dir, "answers_view").select("query_id", text.alias("text"), F.array_join(F.transform(invalid, lambda i: i.cast("string")), ",").alias("invalid"))


@query
def answer_quotes(spark, sf_dir):
    return view(spark, sf_dir, "answers_view").select("query_id", joined(G.quotes(F.col("answer")), "|").alias("quotes"))


@query
def quote_support(spark, sf_dir):
    a = view(spark, sf_dir, "answers_view").select("query_id", X.quote_supports(G.quotes(F.col("answer")), F.col("context")).alias("supports"))
    return a.select("query_id", F.posexplode("supports").alias("n", "support")).withColumn("support", F.round("support", 6))


def _reports(spark, sf_dir, answers="answers_view"):
    a = view(spark, sf_dir, answers)
    known = F.array(F.lit("3"), (F.col("conv_id") % 12).cast("string"))
    return G.check_grounding(a.select("query_id", "answer"), a.select("query_id", "n_sources", "context", known.alias("known")))


@query
def grounding(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return r.select("query_id", "verified", F.size("unverified_quotes").alias("n_unverified"), joined(F.col("unknown_articles"), ",").alias("unknown"), F.size("invalid_citations").alias("n_invalid"))


@query
def regeneration(spark, sf_dir):
    """First answers, second ones and the choice between them; both are checked against the passages."""
    return G.choose_regenerated(_reports(spark, sf_dir), _reports(spark, sf_dir, "second_view")).select("query_id", F.md5("text").alias("text"), "verified", "regenerated")


@query
def flag_rate(spark, sf_dir):
    """Share of unverified reports among all answers; ``evaluation`` has that among answered questions."""
    r = _reports(spark, sf_dir)
    return r.agg(F.count("*").alias("answers"), F.round(100 * F.count_if(~F.col("verified")) / F.greatest(F.lit(1), F.count("*")), 1).alias("flag_rate"))


# --- streams -------------------------------------------------------------------------------------


@query
def rate_limit(spark, sf_dir):
    """Events of each user under a limit of four a day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").cast("long").alias("id"))
    return limit_rows(e, 4, 24 * 3600 * 1000).select("id", "allowed")


@query
def rate_limit_stream(spark, sf_dir):
    """The same from a stream, which then gets a row of each user that is older than what it has seen: these late rows are dropped."""
    folder, key = scratch(spark, "requests"), "spark.sql.streaming.stateStore.providerClass"
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("id"))
    late = e.groupBy("key").agg((F.min("ts") - F.expr("interval 400 days")).alias("ts")).withColumn("id", F.lit(-1).cast("long"))
    kept = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in (e, late):
            rows.write.mode("append").parquet(f"{folder}/in")
            source = limit_stream(spark.readStream.schema("key string, ts timestamp, id long").parquet(f"{folder}/in"), 4, 24 * 3600 * 1000)
            source.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, kept) if kept else spark.conf.unset(key)
    return spark.read.schema("key string, id long, allowed boolean").parquet(f"{folder}/out").select("id", "allowed")
