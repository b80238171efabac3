"""Queries that chain the library's operators: retrieval, answers, ratings, expansion, PageRank on text, reports.

Model calls are scripted, so each has a DuckDB oracle. Questions are all user turns,
known by (conv_id, turn); a chunk is known by (conv_id, block), as one number by
``conv_id * 100000 + block``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalogue import EMBED, ORACLES, QUESTIONS, RANKED, SENT, TOKENS, TURNS, WS, _embeddings, _long, graph_sentences_sql, ppr_sql, query, questions, ranked_chunks, ranked_sql, table, turns, valleys_sql
from tessera.functions import providers
from tessera.functions import text as X
from tessera.functions.callstore import CallStore
from tessera.functions.providers import PROMPTS, Scripted
from tessera.operators import blocked, chunking, graph, series, vectors
from tessera.operators.ordering import packed
from tessera.plans import answer as A
from tessera.plans import events, experiment
from tessera.plans.expand import expand_text
from tessera.plans.storage import bucketed, checkpoint_dir, dealt_alike, written
from tessera.sources import dialogue

NODE = 100_000


def fixed(prompt: str) -> int:
    """Characters of a prompt besides its fields."""
    return len(re.sub(r"\{\w+\}", "", PROMPTS[prompt]))


# --- scripted providers, and what they say in SQL


def _answerer(prompt: str) -> str:
    if len(prompt) % 29 == 0:
        raise TimeoutError
    return f'```json\n{{"answer": "n={len(prompt)}"}}\n```'


def _judge(prompt: str) -> str:
    if len(prompt) % 13 == 0:
        raise TimeoutError
    return json.dumps({"rating": 1 + len(prompt) % 100})


def _judge01(prompt: str) -> str:
    return json.dumps({"rating": len(prompt) % 2}) if len(prompt) % 13 else "no rating"


def answers_sql(source: str, prompt: str = "answer") -> str:
    """answered and rated for a table with question, answer (the truth) and context."""
    n = f"({fixed(prompt)} + length(question) + length(context))"
    said = f"(CASE WHEN {n} % 29 = 0 THEN 'error' ELSE 'n=' || {n} END)"
    m = f"({fixed('judge_0_100')} + length(question) + length(coalesce(truth, '')) + length(said))"
    return f"""answered AS (SELECT *, {said} AS said, CASE WHEN {n} % 29 = 0 THEN 'error' ELSE 'ok' END AS status FROM (SELECT * EXCLUDE (answer), answer AS truth FROM {source})),
rated AS (SELECT *, CASE WHEN {m} % 13 = 0 THEN NULL ELSE CAST(1 + {m} % 100 AS DOUBLE) END AS rating FROM answered)"""


CONTEXT = """ctx AS (SELECT conv_id, turn, string_agg(chunk, chr(10) ORDER BY {order}) AS context FROM ranked WHERE rk <= {k} GROUP BY ALL),
asked AS (SELECT qs.*, coalesce(context, '') AS context FROM qs LEFT JOIN ctx USING (conv_id, turn))"""
CATEGORY = "CASE conv_id % 5 WHEN 4 THEN 'single-hop' WHEN 1 THEN 'multi-hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open-domain' ELSE 'Unknown' END"
BY_CATEGORY = f"by_category AS (SELECT {CATEGORY} AS category, avg(rating) AS rating, count(rating) AS n, CAST(count(*) - count(rating) AS BIGINT) AS errors FROM rated GROUP BY 1 HAVING count(rating) > 0)"


def _asked(spark: SparkSession, sf_dir: str, retrieved: DataFrame, order: str, told: DataFrame | None = None) -> DataFrame:
    q = questions(spark, sf_dir, told).withColumn("label", F.col("conv_id") % 5).withColumnRenamed("answer", "truth")
    return A.contexts(q, retrieved, ["conv_id", "turn"], order, "chunk")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with the answer from its three best chunks, and its rating."""
    return A.answer_and_rate(_asked(spark, sf_dir, ranked_chunks(spark, sf_dir, 1, 3), "rk"), Scripted(_answerer), Scripted(_judge))


# --- normalisers, turn lines, prefixes, plot data

_LOOSE = "CASE (conv_id + turn) % 5 WHEN 0 THEN to_json({'chunk': text, 'timestamp': role}) WHEN 1 THEN to_json({'timestamp': NULL, 'chunk': text}) WHEN 2 THEN '{\"other\": 1}' WHEN 3 THEN to_json(text) ELSE CAST(turn AS VARCHAR) END"


@query(
    """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 2 THEN '' WHEN 4 THEN CAST(turn AS VARCHAR) ELSE text END AS chunk,
CASE (conv_id + turn) % 5 WHEN 0 THEN role WHEN 1 THEN NULL ELSE '' END AS timestamp FROM conversations"""
)
def normalise_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and time of chunks that come as objects, texts or other values."""
    c = table(spark, sf_dir, "conversations")
    kind, quoted = (F.col("conv_id") + F.col("turn")) % 5, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    loose = F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("chunk"), F.col("role").alias("timestamp"))))
    loose = loose.when(kind == 1, F.concat(F.lit('{"timestamp": null, "chunk": '), quoted(F.col("text")), F.lit("}"))).when(kind == 2, F.lit('{"other": 1}'))
    v = F.parse_json(loose.when(kind == 3, quoted(F.col("text"))).otherwise(F.col("turn").cast("string")))
    rows = c.select("conv_id", "turn", v.alias("v"))
    return rows.select("conv_id", "turn", X.chunk_text(F.col("v")).alias("chunk"), X.chunk_time(F.col("v")).alias("timestamp"))


@query(f"SELECT conv_id, turn, turn // 2 AS session_ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS flat_ord, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS nested_ord, role || ':' || trim(text, {WS}) || CASE WHEN turn % 3 = 0 THEN ',image:a picture' ELSE '' END AS chunk FROM conversations")
def turn_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a turn, blank ones too, with its place in the conversation and in its session."""
    image = F.when(F.col("turn_ord") % 3 == 0, F.lit("a picture"))
    t = turns(spark, sf_dir).withColumns({"session_ord": F.floor(F.col("turn_ord") / 2), "img_url": image, "query": image})
    return _long(chunking.turn_lines(t), "session_ord", "flat_ord", "nested_ord")


@query("SELECT conv_id, turn, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix FROM conversations")
def prefix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    return series.prefixes(c, ["conv_id"], "turn", "line").select("conv_id", "turn", "prefix")


_TURN_SIMS = f"""{EMBED.format(name='te', ids='conv_id, turn', text='text', source='conversations')},
dots AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, round(sum(a.weight * b.weight), 6) AS sim FROM te a JOIN te b ON a.conv_id = b.conv_id AND a.bucket = b.bucket AND a.turn < b.turn GROUP BY ALL)"""


@query(
    f"""WITH {_TURN_SIMS}, half AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, coalesce(sim, 0) AS value FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn LEFT JOIN dots d ON d.conv_id = a.conv_id AND d.i = a.turn AND d.j = b.turn)
SELECT conv_id, 'turn ' || i AS y, 'turn ' || j AS x, value FROM half UNION ALL SELECT conv_id, 'turn ' || j, 'turn ' || i, value FROM half UNION ALL SELECT conv_id, 'turn ' || turn, 'turn ' || turn, 1 FROM conversations"""
)
def heatmap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each conversation's similarity matrix with their labels, as a plot takes them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    sims = vectors.sparse_pairs(vectors.hash_embedding(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text"), "conv_id", "turn")
    return vectors.cells(c, sims, "conv_id", "turn").select("conv_id", F.concat(F.lit("turn "), F.col("i").cast("string")).alias("y"), F.concat(F.lit("turn "), F.col("j").cast("string")).alias("x"), "value")


# --- embeddings, cosines, keyed pairs, graph totals


def _toy(text: str) -> list[float]:
    return [float(len(text)), float(text.count("e")), float(text.count(" ")), 1.0]


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN ' ' || chr(10) ELSE trim(text, {WS}) END AS t FROM conversations),
b AS (SELECT *, length(trim(t, {WS})) = 0 AS blank FROM t)
SELECT conv_id, turn, CASE WHEN blank THEN 0 ELSE length(t) END::DOUBLE AS chars, CASE WHEN blank THEN 0 ELSE length(t) - length(replace(t, 'e', '')) END::DOUBLE AS es, CASE WHEN blank THEN 0 ELSE length(t) - length(replace(t, ' ', '')) END::DOUBLE AS gaps, CASE WHEN blank THEN 0 ELSE 1 END::DOUBLE AS one, CASE WHEN blank THEN 'blank' ELSE 'ok' END AS status FROM b"""
)
def embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from an embedding provider, asked in batches; blank texts are zero vectors."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.when(F.col("turn") % 7 == 3, F.lit(" \n")).otherwise(F.col("text")))
    e = providers.embed(c, providers.ScriptedEmbedder(_toy), "t", 4, budget=500)
    return e.select("conv_id", "turn", *[F.col("vec")[i].cast("double").alias(n) for i, n in enumerate(("chars", "es", "gaps", "one"))], F.col("embed_status").alias("status"))


@query(
    """WITH z AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
SELECT a.vec_id, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 0 ELSE round(list_cosine_similarity(a.v, b.v), 6) END AS cosine FROM z a JOIN z b ON b.vec_id = a.vec_id + 1"""
)
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the next one; zero vectors have cosine 0 with all."""
    zero = F.transform("v", lambda x: x * 0)
    e = _embeddings(spark, sf_dir).withColumn("v", F.when(F.col("vec_id") % 10 == 0, zero).otherwise(F.col("v")))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


_LABELLED = "pairs AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query(f"WITH {_LABELLED} SELECT label, i, j, sim FROM pairs WHERE sim > 0.1")
def keyed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a key."""
    e = table(spark, sf_dir, "embeddings")
    return blocked.all_pairs(e, "vec_id", "embedding", over=0.1, block=32, keys=["label"])


@query(f"WITH {_LABELLED} SELECT label, i // 25 AS src, j // 25 AS dst, max(sim) AS sim FROM pairs WHERE i // 25 <> j // 25 GROUP BY ALL")
def keyed_max_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest similarity between members of two owners, within a key."""
    e = table(spark, sf_dir, "embeddings")
    return blocked.owner_maxima(e, "vec_id", "embedding", lambda ids: ids // 25, block=32, keys=["label"])


_TEXT_GRAPH = f"""{EMBED.format(name='ne', ids='conv_id, block', text='chunk', source='chunks')},
edges AS (SELECT a.conv_id, a.block AS src, b.block AS dst, round(sum(a.weight * b.weight), 6) AS weight FROM ne a JOIN ne b ON a.conv_id = b.conv_id AND a.bucket = b.bucket AND a.block < b.block GROUP BY ALL HAVING round(sum(a.weight * b.weight), 6) > 0.5),
sym AS (SELECT conv_id * {NODE} + src AS node, conv_id * {NODE} + dst AS neighbor, weight FROM edges UNION ALL SELECT conv_id * {NODE} + dst, conv_id * {NODE} + src, weight FROM edges),
nodes AS (SELECT conv_id * {NODE} + block AS node, chunk FROM chunks)"""


def text_graph(spark: SparkSession, sf_dir: str, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, node, chunk) and edges (conv_id, src, dst, weight, edge_type) of the chunks of every conversation."""
    chunks = chunking.turn_chunks(turns(spark, sf_dir), rounds)
    node = packed("conv_id", "block", NODE).alias("node")
    nodes = chunks.select("conv_id", node, "chunk")
    sims = vectors.sparse_pairs(vectors.hash_embedding(nodes, ["conv_id", "node"], "chunk"), "conv_id", "node")
    return nodes, graph.simple_edges(sims, ["conv_id"], 0.5)


@query(f"WITH {RANKED}, {_TEXT_GRAPH} SELECT conv_id, conv_id * {NODE} + src AS src, conv_id * {NODE} + dst AS dst, weight, 'similarity' AS edge_type FROM edges")
def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_graph(spark, sf_dir)[1]


@query(f"WITH {RANKED}, {_TEXT_GRAPH} SELECT 'nodes' AS metric, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'edges: similarity', count(*) FROM edges HAVING count(*) > 0")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(*text_graph(spark, sf_dir))


# --- retrieval, answers and ratings


@query(f"WITH {RANKED} SELECT conv_id, turn, CAST(block AS BIGINT) AS block, row_number() OVER (PARTITION BY conv_id, turn ORDER BY block) AS ord, chunk FROM ranked WHERE rk <= 5")
def retrieve_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of each question in the order of the conversation."""
    return _long(vectors.by_position(ranked_chunks(spark, sf_dir, 1, 5), ["conv_id", "turn"], "block").select("conv_id", "turn", "block", "ord", "chunk"), "block", "ord")


@query(f"WITH {RANKED}, {CONTEXT.format(order='block', k=5)}, {answers_sql('asked')} SELECT conv_id, turn, said AS answer, status, rating FROM rated")
def retrieve_and_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vectors.by_position(ranked_chunks(spark, sf_dir, 1, 5), ["conv_id", "turn"], "block")
    out = A.answer_and_rate(_asked(spark, sf_dir, top, "ord"), Scripted(_answerer), Scripted(_judge))
    return out.select("conv_id", "turn", "answer", "status", "rating")


_ANSWERED = f"WITH {RANKED}, {CONTEXT.format(order='rk', k=3)}, {answers_sql('asked')}"


@query(f"{_ANSWERED} SELECT conv_id, turn, question, truth, context, said AS answer, status, rating, conv_id % 5 AS label FROM rated")
def answer_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question, evidence, answer and rating joined by the question's key."""
    return _rated(spark, sf_dir).select("conv_id", "turn", "question", "truth", "context", "answer", "status", "rating", "label")


@query(f"{_ANSWERED}, {BY_CATEGORY} SELECT category, round(rating, 6) AS rating, n, errors FROM by_category")
def answer_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scores_by_category(_rated(spark, sf_dir)).withColumn("rating", F.round("rating", 6))


@query(f"{_ANSWERED}, {BY_CATEGORY} SELECT round(avg(rating), 6) AS macro, round(sum(rating * n) / sum(n), 6) AS micro, CAST(sum(errors) AS BIGINT) AS errors FROM by_category")
def answer_rate_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overall(_rated(spark, sf_dir)).withColumns({"macro": F.round("macro", 6), "micro": F.round("micro", 6)})


_ZERO_ONE = f"({fixed('judge_0_1')} + length(question) + length(coalesce(answer, '')) + 6)"


@query(f"WITH {QUESTIONS} SELECT conv_id, turn, CASE WHEN {_ZERO_ONE} % 13 = 0 THEN NULL ELSE CAST({_ZERO_ONE} % 2 AS DOUBLE) END AS rating FROM qs")
def judge_zero_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir).withColumnRenamed("answer", "truth").withColumn("answer", F.lit("answer"))
    return A.judge(rows, Scripted(_judge01), "0-1").select("conv_id", "turn", "rating")


@query(
    f"""WITH {QUESTIONS}, whole AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1),
asked AS (SELECT qs.*, context FROM qs JOIN whole USING (conv_id)), {answers_sql("asked", "answer_abstract")} SELECT conv_id, turn, said AS answer, status FROM answered"""
)
def long_context_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question answered from its whole conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    rows = A.long_contexts(questions(spark, sf_dir).drop("answer"), c, "conv_id", "turn", "line")
    return A.answer(rows, Scripted(_answerer), "answer_abstract").select("conv_id", "turn", "answer", "status")


# --- segmentation by model calls


@query(f"WITH t AS (SELECT CAST(item_id AS VARCHAR) || '#' || text AS context FROM benchmark), k AS (SELECT {TOKENS.format(f'(repeat(chr(120), {fixed(chr(115) + "ummary")}) || context)')} AS i FROM (SELECT DISTINCT context FROM t)) SELECT count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(count(*) * 12 AS BIGINT) AS output_tokens, round((sum(i) + count(*) * 12) / greatest(1, count(*)), 6) AS average FROM k")
def call_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and estimated tokens of a stage."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit("#"), "text").alias("context"))
    calls = A.summarize(b, Scripted(lambda p: '{"summary": "x"}'[:16]))
    return providers.report(calls).withColumn("average", F.round("average", 6))


_STRIPPED = f"trim(role || ':' || text, {WS})"
_PREDICT_SQL = f"""WITH RECURSIVE told AS (SELECT conv_id, turn, {_STRIPPED} AS line FROM conversations),
spoken AS (SELECT * FROM (WITH {SENT.format(ws=WS, where="WHERE length(sentence) >= 30").replace("role || ':' || text AS line", f"{_STRIPPED} AS line")})),
st AS (SELECT conv_id, turn, sentence, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sent_idx) - 1 AS i FROM spoken),
said AS (SELECT conv_id, i, string_split(sentence, chr(10))[-1] AS predicted FROM st),
{EMBED.format(name="pe", ids="conv_id, i", text="predicted", source="said")}, {EMBED.format(name="ae", ids="conv_id, i", text="sentence", source="st")},
near AS (SELECT a.conv_id, a.i, b.i AS j FROM st a JOIN st b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i + 1 AND a.i + 3),
many AS (SELECT conv_id, i, count(*) AS n FROM near GROUP BY ALL),
dots AS (SELECT x.conv_id, x.i, sum(g.weight * h.weight) AS d FROM near x JOIN pe g ON g.conv_id = x.conv_id AND g.i = x.i JOIN ae h ON h.conv_id = x.conv_id AND h.i = x.j AND h.bucket = g.bucket GROUP BY ALL),
sims AS (SELECT conv_id, i, round(coalesce(d, 0) / n, 6) AS sim FROM many LEFT JOIN dots USING (conv_id, i)),
{valleys_sql("sims", "conv_id", "i", "sim")},
marks AS (SELECT DISTINCT st.conv_id, turn FROM valleys v JOIN st ON st.conv_id = v.conv_id AND st.i = v.i + 1 WHERE turn > 0),
cuts AS (SELECT t.conv_id, t.turn, line, sum(CASE WHEN m.turn IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS segment FROM told t LEFT JOIN marks m ON m.conv_id = t.conv_id AND m.turn = t.turn)
SELECT conv_id, CAST(segment AS BIGINT) AS segment, string_agg(line, chr(10) ORDER BY turn) AS chunk FROM cuts GROUP BY conv_id, segment"""


@query(_PREDICT_SQL)
def segment_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, predictions of the next one (the stand-in repeats the last line), valleys of the similarity, cuts."""
    line = F.concat("role", F.lit(":"), "text")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.strip(line).alias("line"))
    sentences = t.select("conv_id", "turn", F.posexplode(X.turn_sentences(F.col("line"), 30)).alias("p", "sentence"))
    return experiment.segment_by_prediction(t, sentences, Scripted(lambda p: p[p.rindex("\n") + 1 :])).select("conv_id", F.col("segment").cast("bigint").alias("segment"), "chunk")


@query()
def exact_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by a tokenizer file."""
    import public_tokenizers

    count = providers.exact_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


# --- expansion and PageRank on text


def _steps_sql(score: str) -> str:
    """d1 to d3 (q_id, node, round) from d0, sym and nodes; ``score`` of a node (its chunk, c.q_id) is its relevance."""
    steps = ["fr0 AS (SELECT q_id, node FROM d0), v0 AS (SELECT q_id, node FROM d0), on0 AS (SELECT DISTINCT q_id FROM d0)"]
    for r in (1, 2, 3):
        p = r - 1
        steps.append(
            f"act{r} AS (SELECT q_id FROM d{p} SEMI JOIN on{p} USING (q_id) GROUP BY q_id HAVING count(*) < 5),"
            f"c{r} AS (SELECT DISTINCT f.q_id, s.neighbor AS node FROM fr{p} f JOIN sym s USING (node) WHERE f.q_id IN (SELECT q_id FROM act{r}) AND NOT EXISTS (SELECT 1 FROM v{p} v WHERE v.q_id = f.q_id AND v.node = s.neighbor)),"
            f"v{r} AS (SELECT q_id, node FROM v{p} UNION ALL SELECT q_id, node FROM c{r}),"
            f"fr{r} AS (SELECT c.q_id, c.node FROM c{r} c JOIN nodes USING (node) WHERE {score} >= 5),"
            f"d{r} AS (SELECT * FROM d{p} UNION ALL SELECT q_id, node, {r} AS round FROM fr{r}),"
            f"on{r} AS (SELECT DISTINCT q_id FROM fr{r})"
        )
    return ",".join(steps)


def _expand_sql(size: int = 2) -> str:
    return f"WITH {QUESTIONS}, {ranked_sql(size)}, {_TEXT_GRAPH}, d0 AS (SELECT conv_id * 1000000 + turn AS q_id, conv_id * {NODE} + block AS node, 0 AS round FROM ranked WHERE rk <= 3), {_steps_sql('1 + (length(chunk) + c.q_id) % 10')}"


def _sufficient(prompt: str) -> str:
    if "time:None,content:" not in prompt:
        raise TimeoutError
    return json.dumps({"result": 2 if prompt.count("time:None,content:") >= 5 else 1})


def _relevant(prompt: str) -> str:
    q = int(re.search(r"Question: (\d+) ", prompt)[1])
    listed = json.loads(prompt[prompt.index("\n{") + 1 :])
    return "```json\n" + json.dumps({"results": [{"doc_id": int(k), "score": 1 + (len(v) + q) % 10} for k, v in listed.items()]}) + "\n```"


def _anchors(spark: SparkSession, sf_dir: str, k: int = 3, rounds: int = 1) -> DataFrame:
    q, node = packed("conv_id", "turn", TURNS), packed("conv_id", "block", NODE)
    return ranked_chunks(spark, sf_dir, rounds, k).select(q.alias("q_id"), node.alias("node"), "rk")


def _asked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = packed("conv_id", "turn", TURNS)
    return questions(spark, sf_dir).select(q.alias("q_id"), F.concat(q.cast("string"), F.lit(" "), "question").alias("question"))


def _expanded(spark: SparkSession, sf_dir: str, edges: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    nodes = written(text_graph(spark, sf_dir, rounds)[0].select("node", "chunk", F.lit(None).cast("string").alias("timestamp")), "nodes")
    return expand_text(_asked_ids(spark, sf_dir), written(_anchors(spark, sf_dir, rounds=rounds).select("q_id", "node", "rk"), "anchors"), nodes, bucketed(graph.symmetric(edges, []), "edges", "node"), Scripted(_sufficient), Scripted(_relevant))


@query(_expand_sql() + " SELECT q_id, node, CAST(round AS BIGINT) AS round, 'time:None,content:' || chunk AS doc FROM d3 JOIN nodes USING (node)")
def expand_on_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion from the three best chunks of every question; both judgements come from providers."""
    return _long(_expanded(spark, sf_dir, text_graph(spark, sf_dir)[1])[0].select("q_id", "node", "round", "doc"), "round")


#: The provider sees a JSON object of numbered lines, whose quotes, backslashes and line ends take two characters each.
_EVENT_TOKENS = f"""WITH l AS (SELECT conv_id, sum(length(to_json(role || ':' || trim(text, {WS})))) + sum(length(CAST(turn AS VARCHAR)) + 3) + count(*) + 1 AS n FROM conversations GROUP BY 1),
t AS (SELECT CAST(ceil(({fixed("situation")} + n) * 0.74::DOUBLE) AS BIGINT) AS i, CAST(ceil({len('{"topic_boundaries": []}')} * 0.74::DOUBLE) AS BIGINT) AS o FROM l)"""

_ABLATED = (
    "m AS (SELECT q_id, string_agg('time:None,content:' || chunk, chr(10) ORDER BY round, node) AS context FROM {docs} JOIN nodes USING (node) GROUP BY 1),"
    " asked AS (SELECT qs.*, coalesce(context, '') AS context FROM qs LEFT JOIN m ON m.q_id = qs.conv_id * 1000000 + qs.turn), " + answers_sql("asked") + " SELECT '{variant}' AS variant, count(*) AS n, round(avg(rating), 6) AS rating FROM rated"
)


@query(_expand_sql() + ", a AS (WITH " + _ABLATED.format(docs="d3", variant="whole") + "), b AS (WITH " + _ABLATED.format(docs="d0", variant="without edges") + ") SELECT * FROM a UNION ALL SELECT * FROM b")
def ablation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval on the whole graph and on an altered one, answered and rated."""
    edges = text_graph(spark, sf_dir)[1]
    out = None
    for variant, e in (("whole", edges), ("without edges", graph.without_type(edges, "similarity"))):
        docs = _expanded(spark, sf_dir, e)[0]
        rated = A.answer_and_rate(_by_question(spark, sf_dir, docs), Scripted(_answerer), Scripted(_judge))
        row = rated.agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("rating")).select(F.lit(variant).alias("variant"), "n", "rating")
        out = row if out is None else out.unionByName(row)
    return out


@query(" UNION ALL ".join(f"SELECT * FROM ({_expand_sql(size)}, {_ABLATED.format(docs='d3', variant=name)})" for name, size in (("turn", 2), ("double", 4))))
def ablation_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval on the graphs of two ways to chunk, each built and expanded anew, answered and rated."""
    out = None
    for name, rounds in (("turn", 1), ("double", 2)):
        docs = _expanded(spark, sf_dir, text_graph(spark, sf_dir, rounds)[1], rounds)[0]
        rated = A.answer_and_rate(_by_question(spark, sf_dir, docs), Scripted(_answerer), Scripted(_judge))
        row = rated.agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("rating")).select(F.lit(name).alias("variant"), "n", "rating")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_EVENT_TOKENS} SELECT 'boundaries' AS stage, count(*) AS calls, 0::BIGINT AS errors, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round((sum(i) + sum(o)) / greatest(1, count(*)), 6) AS average FROM t")
def segmentation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and estimated tokens of segmenting all dialogues by a provider."""
    lines = turns(spark, sf_dir).select("conv_id", "turn_ord", F.concat("speaker", F.lit(":"), X.strip(F.col("text"))).alias("line"))
    store = CallStore(spark)
    A.boundaries(chunking.numbered_lines(lines, ["conv_id"], "turn_ord", "line"), Scripted(lambda p: '{"topic_boundaries": []}'), "situation", store=store, stage="boundaries")
    return store.ledger({"boundaries": "call_id"}).withColumn("average", F.round("average", 6))


def _by_question(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    q = questions(spark, sf_dir).withColumnRenamed("answer", "truth").withColumn("q_id", packed("conv_id", "turn", TURNS))
    return A.contexts(q, docs.withColumn("o", F.struct("round", "node")), ["q_id"], "o", "doc")


@query(
    f"""WITH RECURSIVE {RANKED}, {_TEXT_GRAPH},
seeds AS (SELECT conv_id * 1000000 + turn AS q_id, conv_id * {NODE} + block AS node, 1.0::DOUBLE / count(*) OVER (PARTITION BY conv_id, turn) AS p FROM ranked WHERE rk <= 3),
{ppr_sql(1e-5, 160)}
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY rank DESC, node) AS rk, node, chunk FROM ranks JOIN nodes USING (node) QUALIFY rk <= 4"""
)
def ppr_on_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four chunks of the highest personalised rank for every question, in rank order."""
    nodes, edges = text_graph(spark, sf_dir)
    a = _anchors(spark, sf_dir)
    seeds = written(a.withColumn("p", F.lit(1.0) / F.count("*").over(Window.partitionBy("q_id"))).select("q_id", "node", "p"), "anchors")
    x = graph.personalized_pagerank(nodes.select("node"), graph.symmetric(written(edges, "edges"), []), seeds)
    top = vectors.top_k(x.withColumn("rank", F.round("rank", 6)), ["q_id"], "node", 4, "rank")
    return _long(top.join(nodes.select("node", "chunk"), "node").select("q_id", "rk", "node", "chunk"), "rk")


@query(f"WITH {RANKED} SELECT conv_id * 1000000 + turn AS q_id, conv_id * {NODE} + block AS node, rk FROM ranked WHERE rk <= 3")
def stored_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every question among the nodes of a graph that was stored and loaded."""
    path = f"{checkpoint_dir(spark)}/graph-{experiment.name()}"
    dialogue.save_graph(*text_graph(spark, sf_dir), path)
    nodes, _ = dialogue.load_graph(spark, path)
    q = vectors.hash_embedding(questions(spark, sf_dir).withColumn("q_id", packed("conv_id", "turn", TURNS)), ["conv_id", "q_id"], "question")
    top = vectors.top_k(vectors.sparse_scores(q, vectors.hash_embedding(nodes, ["conv_id", "node"], "chunk"), ["conv_id"], ["q_id", "node"]), ["q_id"], "node", 3)
    return _long(top.select("q_id", "node", "rk"), "rk")


@query(
    """SELECT conv_id, turn // 2 AS session_ord, 'day ' || (turn // 2) AS date_time, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1 AS turn_ord, role AS speaker, text, 'D' || (turn // 2) || ':' || turn AS dia_id, CASE WHEN turn % 3 = 0 THEN 'a picture' END AS query FROM conversations"""
)
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the nested dialogue files that are first made of the conversations, a dialogue a line."""
    c = table(spark, sf_dir, "conversations").withColumn("s", F.floor(F.col("turn") / 2))
    said = F.struct(F.col("role").alias("speaker"), "text", F.concat(F.lit("D"), F.col("s").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("dia_id"), F.when(F.col("turn") % 3 == 0, F.lit("a picture")).alias("query"))
    told = c.groupBy("conv_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))), lambda x: x["t"]).alias("turns"))
    named = lambda end: F.concat(F.lit("session_"), F.col("s").cast("string"), F.lit(end))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    both = told.select("conv_id", "s", F.concat(quoted(named("")), F.lit(":"), F.to_json("turns"), F.lit(","), quoted(named("_date_time")), F.lit(":"), quoted(F.concat(F.lit("day "), F.col("s").cast("string")))).alias("j"))
    whole = both.groupBy("conv_id").agg(chunking.ordered_join("s", "j", ",").alias("j"))
    path = f"{checkpoint_dir(spark)}/dialogues-{experiment.name()}"
    whole.select(F.concat(F.lit('{"sample_id":'), F.col("conv_id").cast("string"), F.lit(',"conversation":{'), "j", F.lit('},"qa":[]}')).alias("value")).write.text(path)
    rows = dialogue.turns(dialogue.sessions(dialogue.read_dialogues(spark, path, lines=True, id_key="sample_id")))
    return _long(rows.select("conv_id", "session_ord", "date_time", "turn_ord", "speaker", "text", "dia_id", "query"), "conv_id", "session_ord", "turn_ord")


# --- comparisons and batches

_METHODS = (("turn", 1, 2), ("double", 2, 4), ("session", 100, 200))


def _methods_sql() -> str:
    rows = " UNION ALL ".join(
        f"(WITH {ranked_sql(size)}, {CONTEXT.format(order='rk', k=3)}, {answers_sql('asked')}, {BY_CATEGORY} SELECT '{name}' AS method, category, round(rating, 6) AS rating, n FROM by_category)" for name, _, size in _METHODS
    )
    return f"WITH {QUESTIONS} {rows}"


@query(_methods_sql())
def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions over chunks of several kinds, answered and rated in one job."""
    out = None
    told = turns(spark, sf_dir).repartition("conv_id")  # so texts of a conversation meet without being moved again
    for name, rounds, _ in _METHODS:
        rows = _asked(spark, sf_dir, ranked_chunks(spark, sf_dir, rounds, 3, told), "rk", told).withColumn("method", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    with dealt_alike(spark):
        rated = A.answer_and_rate(out, Scripted(_answerer), Scripted(_judge))
    return A.scores_by_category(rated, ["method"]).select("method", "category", F.round("rating", 6).alias("rating"), "n")


@query(
    f"""{_ANSWERED}, {_TEXT_GRAPH}
SELECT 'chunks' AS stage, conv_id, count(*) AS n FROM chunks GROUP BY ALL UNION ALL SELECT 'edges', conv_id, count(*) FROM edges GROUP BY ALL
UNION ALL SELECT 'retrieved', conv_id, count(*) FROM ranked WHERE rk <= 3 GROUP BY ALL UNION ALL SELECT 'answers', conv_id, count(*) FROM rated GROUP BY ALL UNION ALL SELECT 'rated', conv_id, count(rating) FROM rated GROUP BY ALL"""
)
def experiment_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch over all conversations whose stages are written by conversation; rows of each as read back."""
    path = f"{checkpoint_dir(spark)}/experiment-{experiment.name()}"
    stages = experiment.run(turns(spark, sf_dir), path, Scripted(_answerer), Scripted(_judge))
    count = lambda s, c="*": stages[s].groupBy("conv_id").agg(F.count(c).alias("n"))
    parts = [("chunks", count("chunks")), ("edges", count("edges")), ("retrieved", count("retrieved")), ("answers", count("rated")), ("rated", count("rated", "rating"))]
    out = None
    for name, t in parts:
        t = t.select(F.lit(name).alias("stage"), F.col("conv_id").cast("bigint").alias("conv_id"), "n")
        out = t if out is None else out.unionByName(t)
    return out



# --- the run on events

_OVER = (0.7, 0.8)
_EVENT_SQL = f"""WITH cuts AS ({ORACLES["cut_by_boundaries"]}),
nodes AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id, segment) - 1 AS node, chunk FROM cuts),
{graph_sentences_sql("nodes", "conv_id, node", "chunk")},
said AS (SELECT conv_id, node, row_number() OVER (ORDER BY node, ln, i) AS sid, sentence FROM s WHERE length(sentence) >= 30),
{QUESTIONS}, asking AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS q_id FROM qs),
{EMBED.format(name="ne", ids="conv_id, node", text="chunk", source="nodes")}, {EMBED.format(name="se", ids="conv_id, node, sid", text="sentence", source="said")}, {EMBED.format(name="qe", ids="conv_id, q_id", text="question", source="asking")},
ts AS (SELECT a.node AS src, b.node AS dst, round(sum(a.weight * b.weight), 6) AS t FROM ne a JOIN ne b ON a.conv_id = b.conv_id AND a.bucket = b.bucket AND a.node < b.node GROUP BY ALL),
sp AS (SELECT a.node AS src, b.node AS dst, a.sid AS x, b.sid AS y, round(sum(a.weight * b.weight), 6) AS sim FROM se a JOIN se b ON a.conv_id = b.conv_id AND a.bucket = b.bucket AND a.node < b.node GROUP BY ALL),
ss AS (SELECT src, dst, max(sim) AS s FROM sp GROUP BY ALL),
typed AS (SELECT src, dst, coalesce(t, 0) AS t, coalesce(s, 0) AS s FROM ts FULL JOIN ss USING (src, dst) WHERE src IN (SELECT node FROM se) AND dst IN (SELECT node FROM se)),
edges AS (SELECT src, dst, CASE WHEN t > {_OVER[0]} AND s > {_OVER[1]} THEN greatest(t, s) WHEN t > {_OVER[0]} THEN t ELSE s END AS weight FROM typed WHERE t > {_OVER[0]} OR s > {_OVER[1]}),
sym AS (SELECT src AS node, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges),
scored AS (SELECT q.q_id, n.node, round(sum(q.weight * n.weight), 6) AS score FROM qe q JOIN ne n ON q.conv_id = n.conv_id AND q.bucket = n.bucket GROUP BY ALL),
anchors AS (SELECT q_id, node, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, node) AS rk FROM scored QUALIFY rk <= 3),
d0 AS (SELECT q_id, node, 0 AS round FROM anchors), {_steps_sql("1 + length(chunk) % 10")},
docs AS (SELECT d3.q_id, round, CASE WHEN round = 0 THEN rk ELSE d3.node END AS ord, 'time:None,content:' || chunk AS doc FROM d3 JOIN nodes USING (node) LEFT JOIN anchors a ON a.q_id = d3.q_id AND a.node = d3.node),
held AS (SELECT q_id, string_agg(doc, chr(10) ORDER BY round, ord) AS context, count(*) AS n_docs FROM docs GROUP BY 1),
asked AS (SELECT asking.*, coalesce(context, '') AS context, coalesce(n_docs, 0) AS n_docs FROM asking LEFT JOIN held USING (q_id)), {answers_sql("asked")}"""


def _segmenter(prompt: str) -> str:
    lines = json.loads(prompt[prompt.index("\n{") + 1 :])
    return json.dumps({"topic_boundaries": [{"boundary_index": int(k), "reason": "speaker"} for k, v in lines.items() if v.startswith("user:") and int(k) > 0]})


def _by_length(prompt: str) -> str:
    return json.dumps({"results": [{"doc_id": int(k), "score": 1 + len(v) % 10} for k, v in json.loads(prompt[prompt.index("\n{") + 1 :]).items()]})


def _event_stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    models = events.Models(Scripted(_segmenter), Scripted(_sufficient), Scripted(_by_length), Scripted(_answerer), Scripted(_judge))
    return events.run(turns(spark, sf_dir), f"{checkpoint_dir(spark)}/events-{experiment.name()}", models, text_over=_OVER[0], sentence_over=_OVER[1])


@query(f"{_EVENT_SQL} SELECT conv_id, turn, CAST(n_docs AS BIGINT) AS n_docs, said AS answer, status, rating FROM rated")
def event_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run on events: segments, typed graph, expansion, answers and ratings of every question."""
    out = _event_stages(spark, sf_dir)
    found = out["found"].groupBy("q_id").agg(F.count("*").alias("n_docs"))
    return out["rated"].join(found, "q_id", "left").select("conv_id", "turn", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "answer", "status", "rating")
