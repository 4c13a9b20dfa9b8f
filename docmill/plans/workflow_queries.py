"""Status and metadata of documents, reranking and chat by injected services, files as stored content."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from docmill.functions import chunking, outline
from docmill.operators import documents as D, evaluation, ingest as I, retrieval as V
from docmill.operators.lineage import cut, delete, scratch, spread
from docmill.plans import search_queries as S
from docmill.plans.proxies import oracle as o
from docmill.plans.registry import query
from docmill.sources import files
from docmill.streaming import uploads

_NOW = "2024-03-01 12:00:00"


@query("r23_marked", o("p_documents", f"""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'published' WHEN 2 THEN 'failed' WHEN 3 THEN 'processing' ELSE status END AS status,
    CASE WHEN doc_id % 5 = 3 THEN TIMESTAMP '{_NOW}' END AS processing_started_at, CASE WHEN doc_id % 5 IN (1, 2) THEN TIMESTAMP '{_NOW}' END AS processing_completed_at,
    CASE WHEN doc_id % 5 = 1 THEN nullif(doc_id % 7, 0) END AS chunks_count, CASE WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'Timeout' ELSE 'Unknown error' END END AS error_message FROM p_documents"""))
def _(t):
    docs, turn = t("p_documents"), F.col("doc_id") % 5
    outcome = F.when(turn == 1, "completed").when(turn == 2, "failed").when(turn == 3, "processing")
    rows = docs.select("doc_id", outcome.alias("outcome"), F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("chunks_count"), F.lit(None).cast("long").alias("embeddings_count"), F.when(F.col("doc_id") % 2 == 0, "Timeout").alias("error")).where("outcome is not null")
    earlier = rows.where("outcome = 'completed'").withColumn("outcome", F.lit("failed"))  # a completion counts over a failure
    return D.mark(docs, rows.unionByName(earlier), _NOW).select("doc_id", "status", "processing_started_at", "processing_completed_at", "chunks_count", "error_message")


@query("r24_reprocessed", o("p_documents", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'processing' ELSE status END AS status, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN 'markdown' ELSE 'default' END AS chunking_strategy FROM p_documents"""))
def _(t):
    docs = t("p_documents").withColumns({"chunking_strategy": F.lit("default"), "embedding_model": F.lit("m1")})
    own = docs.select(F.col("uploader_id").alias("account_id"), "doc_id")
    asked = own.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("account_id")).alias("account_id"), F.when(F.col("doc_id") % 4 == 0, "markdown").alias("chunking_strategy"), F.lit(None).cast("string").alias("embedding_model"))
    unknown = asked.withColumn("doc_id", F.col("doc_id") + 10**12)
    return D.reprocess(docs, asked.unionByName(unknown), own).select("doc_id", "status", "chunking_strategy")


@query("r24_refused", o("p_documents", """SELECT CAST(d + doc_id AS BIGINT) AS doc_id, CASE WHEN d > 0 THEN 'not found' WHEN doc_id % 3 = 0 THEN 'no write permission' END AS refused FROM p_documents, (VALUES (0), (1000000000000)) v(d) WHERE doc_id % 2 = 0"""))
def _(t):
    own = t("p_documents").select(F.col("uploader_id").alias("account_id"), "doc_id")
    asked = own.where("doc_id % 2 = 0").withColumn("account_id", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("account_id")))
    return D.judged(asked.unionByName(asked.withColumn("doc_id", F.col("doc_id") + 10**12)), t("p_documents"), own).select("doc_id", "refused")


@query("r24_metadata", o("p_documents", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_language END AS lang, CASE WHEN doc_id % 3 <> 2 THEN 'new' END AS tag, original_name AS name FROM p_documents"""))
def _(t):
    docs = t("p_documents").select("doc_id", F.create_map(F.lit("lang"), F.col("doc_language"), F.lit("name"), F.col("original_name")).alias("metadata"))
    change = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("lang"), F.lit(None).cast("string"), F.lit("tag"), F.lit("new"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("tag"), F.lit("new")))
    changes = docs.select("doc_id", change.alias("metadata")).where("metadata is not null")
    return D.update_metadata(docs, changes).select("doc_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "tag", "name")])


def _overlap(pairs: list) -> list:
    """Stands in for a cross-encoder: how many distinct words question and text share."""
    return [len(set(a.lower().split()) & set(b.lower().split())) for a, b in pairs]


@query("r17_rerank_scored", o(S._ACL, S._HITS.replace("rank <= 5)", "rank <= 20)") + """, w AS (SELECT question_id, chunk_id, len(list_intersect(list_filter(string_split_regex(lower(qt.text), '\\s+'), lambda x: x <> ''), list_filter(string_split_regex(lower(left(d.text, 300)), '\\s+'), lambda x: x <> ''))) AS n FROM r JOIN qt USING (question_id) JOIN k USING (chunk_id) JOIN documents d USING (doc_id))
    SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n DESC, chunk_id) AS INTEGER) AS rank, chunk_id, CAST(n AS DOUBLE) AS relevance FROM w QUALIFY rank <= 3"""))
def _(t):
    texts = t("p_chunks").select("chunk_id", "doc_id").join(t("documents").select("doc_id", F.left("text", F.lit(300)).alias("text")), "doc_id")
    asked = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("query"))
    hits = S.permitted(t, 20).drop("rank").join(texts, "chunk_id").join(asked, "question_id")
    return V.rerank_scored(hits, _overlap, 3).select("question_id", "rank", "chunk_id", "relevance")


def _chatty(chats: list) -> list:
    """Stands in for a chat service."""
    return [f"{len(m)} {m[0]['role']} {m[-1]['role']}: {m[-1]['content'][-10:]}" for m in chats]


_LAST = "n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations), l AS (SELECT conv_id, count(*) AS n, max(role) FILTER (WHERE nth = 1) AS role, max(text) FILTER (WHERE nth = 1) AS text FROM n WHERE nth <= 4 GROUP BY 1)"


@query("r19_chat", f"WITH {_LAST} SELECT conv_id, (n + 1) || ' system ' || role || ': ' || right(text, 10) AS answer FROM l")
def _(t):
    lists = I.message_lists(t("conversations"), "conv_id", "turn", "role", "text", 4, "Be brief.")
    return I.chat(lists, "messages", _chatty).select("conv_id", F.col("result").alias("answer"))


@query("r19_chat_pieces", f"WITH {_LAST} SELECT conv_id, unnest(range(2)) AS piece, unnest([left(text, 5), '...']) AS text, left(text, 5) || '...' AS answer FROM l")
def _(t):
    lists = I.message_lists(t("conversations"), "conv_id", "turn", "role", "text", 4)
    rows = I.chat_pieces(lists, "messages", lambda chats: [[m[-1]["content"][:5], "..."] for m in chats])
    return rows.select("conv_id", F.col("piece").cast("long").alias("piece"), "text", F.col("result").alias("answer"))


@query("r3_paragraph_breaks", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
    w AS (SELECT doc_id, no, unnest(regexp_extract_all(para, '\S+')) AS word, unnest(range(1, len(regexp_extract_all(para, '\S+')) + 1)) AS k, len(regexp_extract_all(para, '\S+')) AS n FROM p),
    a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, k) AS pos FROM w)
    SELECT doc_id, CAST(pos AS BIGINT) AS "at" FROM a WHERE k = n OR (n > 100 AND regexp_matches(word, '[.!?]$'))""")
def _(t):
    paragraphs = spread(t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text")))
    return chunking.structural_breaks(paragraphs, "doc_id", "text", 100)


def _docx(text: str) -> bytes:
    """A DOCX file with a paragraph for each line."""
    held = io.BytesIO()
    lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
    return held.getvalue()


@query("s4_docx_texts", "SELECT doc_id, md5(text) AS text_md5, NULL::VARCHAR AS error FROM documents WHERE NOT regexp_matches(text, '[\\x00-\\x09\\x0B-\\x1F]')")
def _(t):
    def stored(frames):
        import pandas as pd

        for f in frames:
            content = [_docx(x) for x in f["text"]]
            yield pd.DataFrame({"path": [f"/in/{i}.docx" for i in f["doc_id"]], "length": [len(c) for c in content], "content": content})

    docs = t("documents").where("text is not null").where(~F.col("text").rlike(r"[\x00-\x09\x0B-\x1F]")).select("doc_id", "text")
    rows = files.parsed(spread(docs).mapInPandas(stored, "path string, length long, content binary"))
    return rows.select(F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


@query("s5_stored_texts", "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN md5(text) END AS text_md5, CASE doc_id % 4 WHEN 2 THEN 'too large' WHEN 3 THEN 'unsupported type' END AS error FROM documents")
def _(t):
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".MD", ".md", ".exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    length = F.when(F.col("doc_id") % 4 == 2, F.lit(files.MAX_BYTES + 1)).otherwise(F.octet_length("text"))
    rows = files.parsed(t("documents").select(F.concat(F.lit("/in/"), "doc_id", ending).alias("path"), length.cast("long").alias("length"), F.col("text").cast("binary").alias("content")))
    return rows.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


_CHUNKS = f"""{S._SECTIONS}, o AS MATERIALIZED ({S._SECTION_ROWS}),
clos AS (SELECT conv_id, section, section AS anc FROM o UNION ALL SELECT c.conv_id, c.section, o.parent FROM clos c JOIN o ON o.conv_id = c.conv_id AND o.section = c.anc WHERE o.parent IS NOT NULL),
sub AS (SELECT conv_id, anc AS section, sum(words) AS below FROM clos JOIN o USING (conv_id, section) GROUP BY 1, 2),
ch AS (SELECT conv_id, path, section, 'SUMMARY' AS kind, conv_id * 1000 + section * 2 AS chunk_id FROM o JOIN sub USING (conv_id, section) WHERE below > 0 UNION ALL SELECT conv_id, path, section, 'DETAIL', conv_id * 1000 + section * 2 + 1 FROM o WHERE words > 0),
v AS MATERIALIZED (SELECT ch.*, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM ch JOIN embeddings e ON e.vec_id = ch.chunk_id % (SELECT count(*) FROM embeddings))"""


def _sectioned(t):
    """Summary and first detail chunks of the conversations' sections, each with a stored vector: by what their ids are modulo the number of vectors."""
    rows = outline.section_chunks(spread(S._outlined(t)), "conv_id", "text").where("sequence = 0")
    rows = rows.withColumn("parent_id", F.col("conv_id") * 1000 + F.col("section") * 2).withColumn("chunk_id", F.col("parent_id") + (F.col("kind") == "detail").cast("long"))
    vectors = t("embeddings").select(F.col("vec_id").alias("_at"), "embedding")
    return rows.withColumn("_at", F.col("chunk_id") % t("embeddings").count()).join(vectors, "_at").drop("_at")


@query("r12_section_details", f"{_CHUNKS}, top AS (SELECT conv_id, section FROM v WHERE kind = 'SUMMARY' ORDER BY score DESC, chunk_id LIMIT 3) SELECT chunk_id, path, round(score, 6) AS score FROM v SEMI JOIN top USING (conv_id, section) WHERE kind = 'DETAIL' ORDER BY v.score DESC, chunk_id LIMIT 4")
def _(t):
    chunks = _sectioned(t)
    best = V.two_stage(chunks.where("kind = 'summary'").drop("parent_id"), chunks.where("kind = 'detail'"), t("embeddings").where("vec_id = 0"))
    return best.select("chunk_id", F.array_join("path", " > ").alias("path"), F.round("score", 6).alias("score"))


@query("r28_section_context", f"{_CHUNKS}, hits AS (SELECT * FROM v ORDER BY score DESC, chunk_id LIMIT 20) SELECT conv_id AS source, string_agg('[' || kind || '] ' || path, chr(10) ORDER BY score DESC, chunk_id) AS context FROM hits GROUP BY 1")
def _(t):
    hits = V.top_k(_sectioned(t), t("embeddings").where("vec_id = 0"), 20)
    line = F.concat(F.lit("["), F.upper("kind"), F.lit("] "), F.array_join("path", " > "))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", line.alias("line"))))
    return hits.groupBy(F.col("conv_id").alias("source")).agg(F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("context"))


@query("t2_uploads_streamed", """SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') AND NOT contains(text, 'license') THEN 'completed' ELSE 'failed' END AS status FROM documents""")
def _(t):
    """Documents that arrive as files of a folder, ingested by a stream in two batches; what it has written of each."""
    base = scratch(t.spark, "uploads")
    docs = t("documents").select("doc_id", "text")
    embed = lambda texts: [None if "license" in x else [float(len(x)), 1.0] for x in texts]
    for turn in (0, 1):
        docs.where(F.col("doc_id") % 2 == turn).write.parquet(f"{base}/in/turn={turn}")
        stream = t.spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        uploads.process(stream, "doc_id", "text", embed, 2, f"{base}/points", f"{base}/status", f"{base}/checkpoint").awaitTermination()
    found = cut(t.spark.read.parquet(f"{base}/status").select("doc_id", "status"))
    delete(t.spark, base)
    return found


def _bag(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("r27_aligned_answers", rf"""WITH t AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer, left(d.text, 2000) AS context FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 JOIN documents d ON d.doc_id = q.conv_id WHERE q.role = 'user'),
    s AS (SELECT conv_id, turn, unnest(string_split_regex(answer, '[.!?\n]+')) AS s, unnest(range(len(string_split_regex(answer, '[.!?\n]+')))) AS i FROM t), sw AS (SELECT conv_id, turn, i, {_bag('s')} AS w FROM s),
    c AS (SELECT conv_id, turn, unnest(string_split_regex(context, '[.!?\n]+')) AS s FROM t), cw AS (SELECT * FROM (SELECT conv_id, turn, {_bag('s')} AS w FROM c) WHERE len(w) > 0),
    best AS (SELECT sw.conv_id, sw.turn, i, coalesce(max(len(list_intersect(sw.w, cw.w)) / len(sw.w)), 0) AS best FROM sw LEFT JOIN cw ON cw.conv_id = sw.conv_id AND cw.turn = sw.turn WHERE len(sw.w) > 0 GROUP BY ALL),
    f AS (SELECT conv_id, turn, avg(best) AS faithfulness FROM best GROUP BY ALL),
    r AS (SELECT conv_id, turn, {_bag('question')} AS q, {_bag('answer')} AS a FROM t), k AS (SELECT r.conv_id, r.turn, avg(len(list_intersect(q, cw.w)) / len(q)) AS relevance FROM r JOIN cw USING (conv_id, turn) WHERE len(q) > 0 GROUP BY ALL)
    SELECT conv_id, turn, round(coalesce(faithfulness, 0), 6) AS faithfulness, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q) ELSE 0 END, 6) AS answer_relevance, round(coalesce(relevance, 0), 6) AS context_relevance FROM r LEFT JOIN f USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)""")
def _(t):
    c = t("conversations")
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answers, ["conv_id", "turn"]).join(t("documents").select(F.col("doc_id").alias("conv_id"), F.left("text", F.lit(2000)).alias("context")), "conv_id")
    return evaluation.evaluate(rows).select("conv_id", "turn", *[F.round(x, 6).alias(x) for x in ("faithfulness", "answer_relevance", "context_relevance")])
