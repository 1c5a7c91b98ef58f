"""The queries of this package and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomledger.llm import canonical as p4
from loomledger.llm import encoding as p8
from loomledger.llm import leakage as p9
from loomledger.llm import markup as p1
from loomledger.llm import neardup as p2
from loomledger.llm import neighbours as p6
from loomledger.llm import packing as p3
from loomledger.llm import residue as p10
from loomledger.llm import sentences as p5
from loomledger.llm import splitting as p7
from loomledger.functions.text import WS
from loomledger.tables import latest, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents whose text or title holds markup."""
    return p1.marked_up(table(spark, root, "documents").select("doc_id", "title", "text"))


def p1_clean(spark: SparkSession, root: str) -> DataFrame:
    """Clean text, title and labelled blocks of every document."""
    return p1.cleaned(table(spark, root, "documents").select("doc_id", "title", "text"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents of at least 400 characters that share at least 0.6 of their three-word sequences."""
    return p2.document_pairs(*p2.links(table(spark, root, "documents").select("doc_id", "text"), words=3, similarity=0.6, min_chars=400))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every document, its group of near-duplicates (five-word shingles, 0.8; below five words exact copies) and its number of links."""
    return p2.groups(*p2.links(table(spark, root, "documents").select("doc_id", "text"), short=True))


def _packed(spark: SparkSession, root: str) -> DataFrame:
    return p3.assign(p3.parts(*(table(spark, root, n) for n in ("pieces", "script_turns", "scripts", "backends"))))


def p3_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The planned chunks of every script, each piece in one of them."""
    return p3.chunks(_packed(spark, root))


def p3_unused(spark: SparkSession, root: str) -> DataFrame:
    """Of each script: the chunks, the fewest that its words can need, and the unused words."""
    from pyspark.sql import functions as F

    c = p3_chunks(spark, root).groupBy("script_id").agg(F.count("*").alias("n_chunks"), F.sum("words").alias("words"), F.max("room").alias("room"))
    return c.select("script_id", "n_chunks", F.ceil(F.col("words") / F.col("room")).alias("fewest"), (F.col("n_chunks") * F.col("room") - F.col("words")).alias("unused"))


def p3_check(spark: SparkSession, root: str) -> DataFrame:
    """Of each script with pieces: how many of them are in its chunks, and whether each is there once and no chunk is over its room."""
    from pyspark.sql import functions as F

    a = _packed(spark, root)
    once = a.groupBy("script_id", "piece_id", "part").agg(F.count("*").alias("n")).groupBy("script_id").agg(F.count_distinct("piece_id").alias("n_pieces"), F.bool_and(F.col("n") == 1).alias("once"))
    room = p3.chunks(a).groupBy("script_id").agg(F.bool_and(F.col("words") <= F.col("room")).alias("within"))
    return once.join(room, "script_id").select("script_id", "n_pieces", (F.col("once") & F.col("within")).alias("sound"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Records of documents and of script turns (a delivery counts once, the latest) that hold disguised characters."""
    from pyspark.sql import functions as F

    docs = p4.changed(table(spark, root, "documents"), "doc_id").select(F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"))
    # a delivery that is canonical can be the latest only where another one is not, so keys are settled after the check
    turns = table(spark, root, "script_turns").select("turn_id", "text", "ingested_at")
    last = latest(turns.select("turn_id", "ingested_at"), "turn_id").withColumnRenamed("ingested_at", "_at")
    found = p4.changed(turns.withColumn("k", F.struct("turn_id", "ingested_at")).select("k", "text"), "k").select("k.turn_id", F.col("k.ingested_at").alias("_at"))
    turn = found.join(last, (found.turn_id == last.turn_id) & found["_at"].eqNullSafe(last["_at"]), "left_semi").select("turn_id").distinct()
    return docs.unionByName(turn.select(F.lit("turn").alias("rec_kind"), F.col("turn_id").alias("rec_id")))


def p4_canonical_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text in its one form."""
    return p4.with_canonical(table(spark, root, "documents").select("doc_id", "text")).select("doc_id", "canonical")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The sentences of the documents named in sentence_docs."""
    docs = table(spark, root, "documents").select("doc_id", "text").join(table(spark, root, "sentence_docs").select("doc_id"), "doc_id", "left_semi")
    return p5.sentences(docs).select("doc_id", "sent_start", "sent_stop")


def p5_document_sentences(spark: SparkSession, root: str) -> DataFrame:
    """The sentences of all documents."""
    return p5.sentences(table(spark, root, "documents"))


def p5_chunk_sentences(spark: SparkSession, root: str) -> DataFrame:
    """The sentences of all chunks; a repeated delivery has its sentences once."""
    return p5.sentences(latest(table(spark, root, "chunks").select("chunk_id", "ingested_at", "text"), "chunk_id").select("chunk_id", "text"), "chunk_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of items of which one is among the five nearest of the other."""
    return p6.pairs(p6.nearest(table(spark, root, "items").select("item_id", "embedding")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that the splitter cuts."""
    return p7.oversized(table(spark, root, "chunks"))


def p7_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All pieces of all chunks; a chunk within the limit is one piece."""
    return p7.split(table(spark, root, "chunks"))


def p7_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Of each chunk: its characters, whether its pieces give it again without their overlaps, and whether all are within the limit."""
    from pyspark.sql import functions as F

    p = p7.split(table(spark, root, "chunks")).where("text is not null")
    # a piece's place says how much of it the one before has
    c = p.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_ix", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), F.char_length("text").alias("n")))).alias("p"))
    joins = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (F.get("p", i)["start"] <= F.get("p", i - 1)["stop"]) & (F.get("p", i)["stop"] > F.get("p", i - 1)["stop"]))
    whole = F.when(F.size("p") > 1, joins).otherwise(True)
    return c.select("chunk_id", (F.element_at("p", -1)["stop"] - F.element_at("p", 1)["start"]).alias("n_bytes"), (whole & F.forall("p", lambda x: x["n"] <= p7.LIMIT)).alias("sound"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """The ids of every document."""
    return p8.encode(table(spark, root, "documents"))


def _premises(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import functions as F

    return table(spark, root, "stance_pairs").select("item_id", F.col("premise").alias("text"))


def p9_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a ten-word passage of a test item, at most one word edited."""
    return p9.leaks(table(spark, root, "documents"), _premises(spark, root))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Those of the leaks that hold a passage of the item without an edit: ten of its words in a row."""
    return p9_leaks(spark, root).where("distance = 0").select("doc_id", "item_id")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents that hold unfilled placeholders, filler, error messages or script notices."""
    return p10.found(table(spark, root, "documents").select("doc_id", "title", "text"))


def p10_unseen_hosts(spark: SparkSession, root: str) -> DataFrame:
    """Weak label and prediction of the documents of hosts that training did not see."""
    return p10.validate(table(spark, root, "documents").select("doc_id", "title", "text", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_groups, p3_chunks, p3_unused, p3_check, p4_found, p4_canonical_documents, p5_found, p5_document_sentences, p5_chunk_sentences, p6_found, p7_found, p7_pieces, p7_round_trip, p8_ids, p9_leaks, p9_found, p10_found, p10_unseen_hosts)}


#: Three-word sequences of the texts of at least 400 characters, and the pairs that share enough of them.
_PAIRS = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> '') AS w FROM documents WHERE length(text) >= 400),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) SELECT a AS doc_a, b AS doc_b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9"""

_NEAREST = """WITH v AS (SELECT item_id, CAST(embedding AS DOUBLE[]) AS e FROM items WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u AS (SELECT item_id, list_transform(e, lambda x: x / n) AS u FROM (SELECT item_id, e, sqrt(list_inner_product(e, e)) AS n FROM v)), r AS (SELECT a.item_id AS a, b.item_id AS b FROM u a JOIN u b ON a.item_id <> b.item_id QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_inner_product(a.u, b.u), 9) DESC, b.item_id) <= 5)
 SELECT DISTINCT least(a, b) AS item_a, greatest(a, b) AS item_b FROM r"""


#: Groups of documents that share enough five-word sequences, by the smallest id reached; texts below five words by their words, those without any alone.
_GROUPS = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{WS}+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE CAST(doc_id AS VARCHAR) || chr(1) END) AS cls FROM d),
 s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM c WHERE len(w) >= 5 AND doc_id = cls), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
 r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b), l AS (SELECT a, min(b) AS least FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
 SELECT doc_id, least(cls, coalesce(l.least, cls)) AS grp, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l ON l.a = c.cls LEFT JOIN k ON k.a = c.cls"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_groups": _GROUPS,
        "p3_check": "SELECT script_id, count(DISTINCT piece_id) AS n_pieces, true AS sound FROM pieces WHERE script_id IN (SELECT script_id FROM scripts) GROUP BY script_id",
        "p7_round_trip": "SELECT chunk_id, octet_length(encode(text)) AS n_bytes, true AS sound FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1) WHERE text IS NOT NULL",
        "p2_found": _PAIRS,
        "p6_found": _NEAREST,
        "p7_found": "SELECT chunk_id FROM (SELECT chunk_id, arg_max(length(text), ingested_at) AS n FROM chunks GROUP BY chunk_id) WHERE n > 2400",
    }
