"""Retrieval: inverted index, field-weighted BM25, exact vector neighbours, hybrid reranking and evidence.

The question set is a table: every benchmark item, and for vectors every row whose id is divisible by
20. Questions meet documents through postings; vectors meet in blocks of a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliogrid.functions import text as X
from foliogrid.functions import tokens as K
from foliogrid.plans import duck as D
from foliogrid.plans.base import BLOCKS, blocks, query
from foliogrid.session import cut, small, table

K1, B = 1.2, 0.75
#: Weights of the indexed fields.
DOCUMENT, SECTION, SUMMARY, KEYWORDS = 10.0, 3.0, 2.0, 2.0
CANDIDATES, ANSWERS = 48, 8


def candidate_count(top_k: int, most: int = CANDIDATES) -> int:
    """Candidates to rerank for ``top_k`` answers."""
    return 0 if top_k <= 0 else min(most, max(top_k * 4, top_k + 8))


def pool_size(top_k: int, configured: int = CANDIDATES) -> int:
    return 0 if top_k <= 0 else min(max(configured, top_k), max(candidate_count(top_k), top_k))


def indexed(docs: DataFrame) -> DataFrame:
    """Rows to index: a document is one, its first line stands for the section and its language for keywords."""
    return docs.where("text is not null").selectExpr("doc_id", "text as document", "split(text, '\\n')[0] as section", "lang as keywords")


FIELDS = {"document": DOCUMENT, "section": SECTION, "keywords": KEYWORDS}
#: Questions that are scored at once against a batch of rows: a matrix of these by ``ROWS`` doubles.
ASKED, ROWS = 256, 4_096
#: Distinct terms of questions that prune postings as they are made; more are pruned by a join.
WANTED = 500_000


def postings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) with tf weighted by field; one pass, a row for each term of each row."""
    return K.field_postings(rows, key, FIELDS).select(key, F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(key, F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))


def row_lengths(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens): tokens of all fields."""
    n = " + ".join(f"{X.token_count(f"coalesce({f}, '')")}" for f in ("document", "section", "keywords"))
    return rows.selectExpr(key, f"cast({n} as long) as tokens")


def question_terms(questions: DataFrame) -> DataFrame:
    """(question, term): the first 32 tokens of each question, each once."""
    return questions.selectExpr("question", f"explode(array_distinct(slice({X.base_tokens('asked')}, 1, 32))) as term")


def bm25(rows: DataFrame, questions: DataFrame, top: int, block: int = 20_000) -> DataFrame:
    """(question, doc_id, rank, score): the ``top`` rows of each question by BM25 with weighted fields.

    Rows are tokenised once, to postings pruned by the questions' terms. Questions are broadcast in blocks of ``block`` with their terms'
    weights; each task scores its rows and hands on only its own ``top`` of each question, so no product of questions and rows is ever shuffled.
    """
    spark = rows.sparkSession
    asked = cut(question_terms(questions))
    wanted = asked.select("term").distinct()
    few = wanted.limit(WANTED + 1).count() <= WANTED
    held = K.field_postings(rows, "doc_id", FIELDS, frozenset(r[0] for r in wanted.collect()) if few else None)
    held = cut(held)
    whole = held.agg(F.count("*").alias("n"), F.avg("tokens").alias("mean")).first()
    found = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(whole.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weights = cut(found.join(wanted, "term", "left_semi").select("term", idf.alias("idf")))
    ids = cut(asked.select("question").distinct())
    parts = max(1, -(-ids.count() // block))
    kind, of = questions.schema["question"].dataType.simpleString(), rows.schema["doc_id"].dataType.simpleString()
    out = None
    for p in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("question"), F.lit(parts)) == p)
        got = mine.join(weights, "term").toArrow()  # 32 rows of each question of a block at most
        index = spark.sparkContext.broadcast(_Questions(got, float(whole["mean"] or 0)))

        def meet(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            yield from index.value.best(batches, top)

        scored = held.select("doc_id", "tokens", "terms", "tfs").mapInArrow(meet, f"question {kind}, doc_id {of}, score double")
        out = scored if out is None else out.unionByName(scored)
    ranked = out.withColumn("rank", F.expr("row_number() over (partition by question order by round(score, 9) desc, doc_id)"))
    return ranked.where(F.col("rank") <= top)


class _Questions:
    """Terms of questions with their weights, by term."""

    def __init__(self, rows: pa.Table, mean: float):
        self.mean = mean
        self.ids, number = np.unique(np.array(rows.column("question").to_pylist(), object), return_inverse=True)
        self.terms = sorted(set(rows.column("term").to_pylist()))
        self.place = {t: i for i, t in enumerate(self.terms)}
        term = np.array([self.place[t] for t in rows.column("term").to_pylist()], np.int64)
        self.idf = np.zeros(len(self.terms))
        self.idf[term] = np.asarray(rows.column("idf"))
        order = np.lexsort((number, term))
        self.asked, self.first = number[order], np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def best(self, batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
        """The ``top`` rows of each question among a task's, ties by id."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                held.append(self.scored(batch.slice(at, ROWS), top))
                if sum(len(x[0]) for x in held) > 4 * top * max(len(self.ids), 1):
                    held = [self.kept(held, top)]
        if held:
            q, d, s = self.kept(held, top)
            for at in range(0, len(q), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q[at : at + 65_536]].tolist()), pa.array(d[at : at + 65_536].tolist(), kinds), pa.array(s[at : at + 65_536])], ["question", "doc_id", "score"])

    def kept(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, s = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, -np.round(s, 9), q))
        q, d, s = q[order], d[order], s[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return q[place < top], d[place < top], s[place < top]

    def scored(self, rows: pa.RecordBatch, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(rows.column(0).to_pylist(), object)
        lists = rows.column(2)
        size = np.diff(np.asarray(lists.offsets))
        place = np.array([self.place.get(t, -1) for t in lists.flatten().to_pylist()], np.int64)
        row = np.repeat(np.arange(len(ids)), size)
        tf = np.asarray(rows.column(3).flatten())
        known = place >= 0
        place, row, tf = place[known], row[known], tf[known]
        length = np.asarray(rows.column(1)).astype(float)
        part = self.idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / self.mean)) if len(place) else np.zeros(0)
        order = np.argsort(place, kind="stable")
        place, row, part = place[order], row[order], part[order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        found = []
        for a in range(0, len(self.ids), ASKED):
            score = np.zeros((min(ASKED, len(self.ids) - a), len(ids)))
            met = np.zeros(score.shape, bool)
            for i, j in zip(cuts, [*cuts[1:], len(place)], strict=True):
                q = self.asked[self.first[place[i]] : self.first[place[i] + 1]]
                q = q[(q >= a) & (q < a + ASKED)] - a
                if len(q):
                    score[np.ix_(q, row[i:j])] += part[i:j]
                    met[np.ix_(q, row[i:j])] = True
            # a row's place among ties is settled later: all that tie with the last one stay
            least = np.partition(np.where(met, score, -np.inf), -top, axis=1)[:, -top] if len(ids) > top else np.full(len(score), -np.inf)
            q, r = np.nonzero(met & (score >= least[:, None] - 1e-9))
            found.append((q + a, ids[r], score[q, r]))
        return self.kept(found, top)


def questions_of(bench: DataFrame) -> DataFrame:
    return bench.where("text is not null").selectExpr("item_id as question", "text as asked")


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')"


def _t(x: str) -> str:
    return _TOK.format(x)


_POSTINGS = f"""
rws as (select doc_id, text as document, string_split(text, chr(10))[1] as section, coalesce(lang, '') as keywords from documents where text is not null),
terms as (select doc_id, unnest({_t('document')}) as term, {DOCUMENT}::double as w from rws union all select doc_id, unnest({_t('section')}), {SECTION}::double from rws union all select doc_id, unnest({_t('keywords')}), {KEYWORDS}::double from rws),
postings as (select doc_id, term, sum(w) as tf from terms group by doc_id, term),
lengths as (select doc_id, (len({_t('document')}) + len({_t('section')}) + len({_t('keywords')}))::bigint as tokens from rws)
"""
_BM25 = f"""
asked as (select distinct item_id as question, term from (select item_id, unnest(({_t('text')})[1:32]) as term from benchmark where text is not null)),
found as (select * from postings where term in (select term from asked)),
st as (select count(*) as n, avg(tokens) as mean from lengths),
dfs as (select term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, any_value(mean) as mean from found, st group by term),
hits as (select question, f.doc_id, sum(idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * tokens / mean))) as score from asked join found f using (term) join dfs using (term) join lengths l on l.doc_id = f.doc_id group by question, f.doc_id),
ranked as (select *, row_number() over (partition by question order by round(score, 9) desc, doc_id)::int as rank from hits)
"""


@query("a06_index_statistics", f"with {_POSTINGS} select term, count(*) as df, sum(tf) as weight from postings group by term")
def a06(spark, sf_dir):
    return postings(indexed(table(spark, sf_dir, "documents"))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("weight"))


@query("a07_index_meta", f"with {_POSTINGS} select count(*) as n, sum(tokens)::bigint as tokens, avg(tokens) as mean from lengths")
def a07(spark, sf_dir):
    return row_lengths(indexed(table(spark, sf_dir, "documents"))).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("mean"))


@query("t04_bm25_top", f"with {_POSTINGS}, {_BM25} select question, doc_id, rank, round(score, 6) as score, least(4.0::double, round(score, 6) + (rank - 1) * 0.08::double) as distance from ranked where rank <= 8")
def t04(spark, sf_dir):
    """The best documents of each question, with the distance that stands for their rank."""
    top = bm25(indexed(table(spark, sf_dir, "documents")), questions_of(table(spark, sf_dir, "benchmark")), ANSWERS)
    return top.select("question", "doc_id", "rank", F.round("score", 6).alias("score"), F.expr("least(4.0D, round(score, 6) + (rank - 1) * 0.08D)").alias("distance"))


def rerank(pool: DataFrame, texts: DataFrame, questions: DataFrame, top: int) -> DataFrame:
    """Candidates (question, doc_id, distance, place) blended with their lexical score, the ``top`` of each question.

    The lexical score is how far a candidate covers a question's tokens: their counts, their kinds and their pairs. Counts meet in a
    join on the term, so a document's tokens are made once, however many questions it is a candidate for.
    """
    pool = cut(pool)
    tokens = questions.selectExpr("question", f"{X.retrieval_tokens('asked')} as qt")
    q = tokens.selectExpr("question", "size(qt) as asked_n", "size(array_distinct(qt)) as kinds", f"array_distinct({X.bigrams('qt')}) as pairs")
    asked = tokens.select("question", F.explode("qt").alias("term")).groupBy("question", "term").agg(F.count("*").alias("qn"))
    held = cut(K.with_retrieval_tokens(texts.join(small(pool.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id", "body"))
    terms = held.select("doc_id", F.explode("ct").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("cn"))
    met = pool.select("question", "doc_id").join(asked, "question").join(terms, ["doc_id", "term"]).groupBy("question", "doc_id").agg(F.sum(F.least("qn", "cn")).alias("matched"), F.count("*").alias("same"))
    docs = held.selectExpr("doc_id", "size(ct) as own_n", f"array_distinct({X.bigrams('ct')}) as own_pairs")
    joined = pool.join(small(q), "question").join(docs, "doc_id").join(met, ["question", "doc_id"], "left")
    lexical = """case when own_n = 0 or asked_n = 0 then 0.0D else least(1.0D, 0.55D * coalesce(matched, 0) / asked_n + 0.35D * coalesce(same, 0) / kinds
        + 0.1D * case when size(pairs) = 0 then 0.0D else size(array_intersect(pairs, own_pairs)) / size(pairs) end) end"""
    scored = joined.withColumn("lexical_score", F.expr(lexical)).withColumn("vector_score", F.expr("1.0D / (1.0D + greatest(distance, 0.0D))"))
    scored = scored.withColumn("retrieval_score", F.expr("0.55D * vector_score + 0.45D * lexical_score"))
    ranked = scored.withColumn("answer", F.expr("row_number() over (partition by question order by round(retrieval_score, 9) desc, round(lexical_score, 9) desc, distance, place)"))
    return ranked.where(F.col("answer") <= top)


_LEX = f"""
q as (select item_id as question, {D.tokens('text')} as qt from benchmark where text is not null),
pool as (select question, doc_id, rank as place, least(4.0::double, round(score, 6) + (rank - 1) * 0.08::double) as distance from ranked where rank <= {pool_size(ANSWERS)}),
c as (select pool.*, qt, {D.tokens("(document || chr(10) || section || chr(10) || keywords)")} as ct from pool join q using (question) join rws using (doc_id)),
cc as (select *, list_distinct(qt) as kinds, list_distinct({D.bigrams('qt')}) as pairs, {D.bigrams('ct')} as cpairs from c),
m as (select question, doc_id, sum(least(qn, cn)) as matched from (select question, doc_id, k, len(list_filter(qt, lambda x: x = k)) as qn, len(list_filter(ct, lambda x: x = k)) as cn from (select question, doc_id, qt, ct, unnest(kinds) as k from cc)) group by question, doc_id),
s as (select cc.*, case when len(ct) = 0 or len(qt) = 0 then 0.0::double else least(1.0::double, 0.55::double * matched / len(qt) + 0.35::double * len(list_intersect(kinds, ct)) / len(kinds) + 0.1::double * case when len(pairs) = 0 then 0.0::double else len(list_intersect(pairs, cpairs)) / len(pairs) end) end as lexical from cc left join m using (question, doc_id)),
b as (select *, 1.0::double / (1.0::double + greatest(distance, 0.0::double)) as vec from s),
r as (select *, 0.55::double * vec + 0.45::double * lexical as blend from b),
a as (select *, row_number() over (partition by question order by round(blend, 9) desc, round(lexical, 9) desc, distance, place)::int as answer from r)
"""


@query("t07_hybrid_evidence", f"with {_POSTINGS}, {_BM25}, {_LEX} select question, answer, 'S' || answer as source_id, doc_id, round(distance, 6) as distance, round(lexical, 6) as lexical_score, round(vec, 6) as vector_score, round(blend, 6) as retrieval_score, {D.preview('document', 120)} as content from a join rws using (doc_id) where answer <= {ANSWERS}")
def t07(spark, sf_dir):
    """Question to evidence: pool by BM25, rerank by words and pairs, number the sources."""
    docs, asked = indexed(table(spark, sf_dir, "documents")), questions_of(table(spark, sf_dir, "benchmark"))
    pool = bm25(docs, asked, pool_size(ANSWERS)).selectExpr("question", "doc_id", "rank as place", "least(4.0D, round(score, 6) + (rank - 1) * 0.08D) as distance")
    texts = docs.selectExpr("doc_id", "concat_ws('\\n', document, section, coalesce(keywords, '')) as body")
    top = rerank(pool, texts, asked, ANSWERS)
    rounded = [F.round(c, 6).alias(c) for c in ("distance", "lexical_score", "vector_score", "retrieval_score")]
    return top.join(docs.select("doc_id", "document"), "doc_id").select("question", "answer", F.expr("concat('S', answer) as source_id"), "doc_id", *rounded, F.expr(f"{X.preview('document', 120)} as content"))


def exact_neighbours(vectors: DataFrame, queries: DataFrame, top: int, block: int = 20_000) -> DataFrame:
    """(query_id, vec_id, distance, rank) by cosine distance, every row against each query but itself.

    Queries are broadcast in blocks of ``block`` at most; a batch of vectors meets a block as one matrix product and keeps
    each query's ``top``, so what is shuffled is small.
    """
    spark = vectors.sparkSession
    rows = queries.where("embedding is not null").select("vec_id", "embedding")
    parts = max(1, -(-rows.count() // block))
    out = None
    for p in range(parts):
        got = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).toArrow()
        m = np.asarray(got.column(1).combine_chunks().flatten(), np.float64).reshape(got.num_rows, -1)
        held = spark.sparkContext.broadcast((np.asarray(got.column(0)), m))

        def meet(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    own = np.asarray(part.column(0))
                    v = np.asarray(part.column(1).flatten(), np.float64).reshape(len(own), -1)
                    long = np.sqrt((v * v).sum(1))
                    for i in range(0, len(ids), ASKED):
                        asked, some = q[i : i + ASKED], ids[i : i + ASKED]
                        d = 1 - (asked @ v.T) / (np.sqrt((asked * asked).sum(1))[:, None] * long[None, :])
                        d[some[:, None] == own[None, :]] = np.inf
                        # all that tie with the last of a query's best stay: ids settle it later
                        last = np.partition(d, top - 1, axis=1)[:, top - 1] if d.shape[1] > top else np.full(len(some), np.inf)
                        a, b = np.nonzero((d <= last[:, None] + 1e-9) & np.isfinite(d))
                        yield pa.RecordBatch.from_arrays([pa.array(some[a]), pa.array(own[b]), pa.array(d[a, b])], ["query_id", "vec_id", "distance"])

        found = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(meet, "query_id long, vec_id long, distance double")
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.expr("row_number() over (partition by query_id order by round(distance, 9), vec_id)"))
    return ranked.where(F.col("rank") <= top)


_COS = "1 - list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(v.embedding::double[], v.embedding::double[]))"


@query("j03_vector_neighbours", f"with d as (select q.vec_id as query_id, v.vec_id, {_COS} as distance from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id), r as (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id)::int as rank from d) select query_id, vec_id, rank, round(distance, 6) as distance from r where rank <= 8")
def j03(spark, sf_dir):
    """Exact vector neighbours; the query's own row is left out before ranking."""
    v = table(spark, sf_dir, "embeddings")
    return exact_neighbours(v, v.where("vec_id % 20 = 0"), ANSWERS).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("w17_even_sample", f"with {BLOCKS}, c as (select *, row_number() over (partition by doc_id order by n) - 1 as i, count(*) over (partition by doc_id) as m from blocks where trim(content) <> '') select distinct doc_id, block_id from c where m <= 8 or list_contains(list_transform(range(8), lambda k: round_even(k * ((m - 1) / 7.0::double), 0)::bigint), i)")
def w17(spark, sf_dir):
    """Eight evenly spaced blocks of a document, where no block matched."""
    c = blocks(spark, sf_dir).where("trim(content) <> ''").withColumn("i", F.expr("row_number() over (partition by doc_id order by n) - 1")).withColumn("m", F.expr("count(*) over (partition by doc_id)"))
    return c.where("m <= 8 or array_contains(transform(sequence(0, 7), k -> cast(bround(k * ((m - 1) / 7.0D), 0) as long)), cast(i as long))").select("doc_id", "block_id").distinct()


@query("t05_head_of_document", f"with {BLOCKS}, r as (select *, row_number() over (partition by doc_id order by page_num, block_id) as k from blocks where trim(content) <> '') select doc_id, block_id, k::int as k from r where k <= 8")
def t05(spark, sf_dir):
    """The head of a document by page and id, ids ordered as text."""
    r = blocks(spark, sf_dir).where("trim(content) <> ''").withColumn("k", F.expr("row_number() over (partition by doc_id order by page_num, block_id)"))
    return r.where("k <= 8").select("doc_id", "block_id", "k")


@query("a08_fingerprints", f"with {BLOCKS} select doc_id, sha256(string_agg(block_id || chr(1) || page_num || chr(1) || block_type || chr(1) || content || chr(1) || case when block_type = 'formula' then 'True' else 'False' end || chr(10), '' order by block_id)) as fingerprint, count(*) as blocks from blocks group by doc_id")
def a08(spark, sf_dir):
    """What an index compares to skip a build: blocks in order of their ids, framed and hashed."""
    row = "concat(block_id, chr(1), page_num, chr(1), block_type, chr(1), content, chr(1), if(block_type = 'formula', 'True', 'False'), '\\n')"
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.expr(f"sha2(array_join(transform(array_sort(collect_list(struct(block_id, {row} as row))), s -> s.row), ''), 256)").alias("fingerprint"), F.count("*").alias("blocks"))
