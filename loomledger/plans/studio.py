"""Queries of the speech and sound operators. The tables hold no recordings: vectors stand for short clips, turns are heard as they are written, and voices are the stand-in's."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.functions import speech, text
from loomledger.operators.audio import bench, frames, signal, takes, verify
from loomledger.plans import sql
from loomledger.plans.register import bar, query, turns_of
from loomledger.tables import table

_TU = sql.latest("script_turns", "turn_id")
_CLIPS = "(SELECT item_id, CAST(embedding AS DOUBLE[]) AS x FROM items WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"
_LEVEL = 0.05


def _clips(spark, root):
    """Vectors of 64 finite members as clips."""
    v = F.col("embedding")
    sound = F.coalesce((F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return table(spark, root, "items").where(sound).select("item_id", v.cast("array<double>").alias("samples"))


_LOUD = f"list_filter(range(1, 65), lambda i: abs(x[i]) > {_LEVEL})"


@query(f"SELECT item_id, CASE WHEN len({_LOUD}) > 0 THEN CAST(list_min({_LOUD}) - 1 AS INTEGER) END AS start, CASE WHEN len({_LOUD}) > 0 THEN CAST(list_max({_LOUD}) AS INTEGER) END AS stop FROM {_CLIPS}")
def trimmed_clips(spark, root):
    return _clips(spark, root).select("item_id", frames.trim_bounds(F.col("samples"), _LEVEL).alias("b")).select("item_id", "b.start", "b.stop")


_PACES = "CASE coalesce(pace, 'normal') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in signal.GAPS.items()) + f" ELSE {signal.GAPS['normal']} END * 48"


@query(f"""WITH b AS (SELECT script_id, turn, pace, CAST(len({sql.words("coalesce(text, '')")}) * 19200 AS BIGINT) AS length FROM {_TU}), l AS (SELECT *, {_PACES} AS gap, lag(length) OVER (PARTITION BY script_id ORDER BY turn) AS before FROM b),
 a AS (SELECT *, length + CASE WHEN before IS NULL THEN 0 WHEN pace = 'interrupt' THEN -least(gap, before, length) ELSE gap END AS adds FROM l) SELECT script_id, turn, CAST(stop - length AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT *, sum(adds) OVER (PARTITION BY script_id ORDER BY turn) AS stop FROM a)""")
def timeline_layout(spark, root):
    """The place of each turn in its episode, at 48,000 samples a second."""
    length = (text.word_count(F.coalesce("text", F.lit(""))) * 19200).cast("bigint")
    return frames.laid_out(turns_of(spark, root).select("script_id", "turn", "pace", length.alias("length")))


@query(f"SELECT item_id, round(list_sum(list_transform(range(1, 65), lambda i: power(x[i] * cos((i - 0.5) / 64 * pi() / 2) + h[i] * sin((i - 0.5) / 64 * pi() / 2), 2))), 6) AS energy FROM (SELECT item_id, x, list_reverse(x) AS h FROM {_CLIPS})")
def crossfaded_clips(spark, root):
    """Each clip faded into its own reverse: the energy of the result."""
    out = _clips(spark, root).select("item_id", frames.crossfaded(F.col("samples"), F.reverse("samples")).alias("y"))
    return out.select("item_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, y: a + y * y), 6).alias("energy"))


@query(f"""WITH b AS (SELECT turn_id, turn * 1000 AS a, turn * 1000 + 20 * len({sql.words("coalesce(text, '')")}) AS z, CASE turn_id % 3 WHEN 0 THEN 'over' WHEN 1 THEN 'before' ELSE 'after' END AS at_, 100 + turn_id % 400 AS n FROM {_TU})
 SELECT turn_id, CAST(CASE at_ WHEN 'over' THEN a + greatest(0, z - a - n) // 2 WHEN 'before' THEN greatest(0, a - n) ELSE z END AS BIGINT) AS start FROM b""")
def overlay_places(spark, root):
    a = (F.col("turn") * 1000).cast("bigint")
    z = a + 20 * text.word_count(F.coalesce("text", F.lit("")))
    k = F.col("turn_id") % 3
    at = F.when(k == 0, "over").when(k == 1, "before").otherwise("after")
    return turns_of(spark, root).select("turn_id", frames.overlay_start(a, z, at, 100 + F.col("turn_id") % 400).alias("start"))


@query(f"SELECT item_id, CAST(0 AS BIGINT) AS n_over, len(list_filter(x, lambda v: abs(v) > 0.2)) > 0 AS touched FROM {_CLIPS}")
def limited_clips(spark, root):
    """The limiter on every clip: nothing stays over the ceiling, and what had nothing over it stays as it is."""
    return frames.limited(_clips(spark, root), "item_id", 0.2, 6)


@query("SELECT script_id, true AS on_target, true AS under_ceiling FROM scripts")
def normalised_clips(spark, root):
    """A tone for each script, brought to the target loudness: within the tolerance, under the ceiling."""
    lines = table(spark, root, "scripts").select("script_id", F.coalesce("backend", F.lit("")).alias("speaker"), (F.col("n_turns") % 4 + 2).alias("words"), F.col("script_id").alias("seed"))
    n = frames.normalised(frames.said_tones(lines, "script_id", 8000), "script_id", 8000)
    return n.select("script_id", (F.abs(F.col("level") - signal.TARGET_LUFS) <= signal.TOLERANCE_LU).alias("on_target"), (F.col("peak") <= signal.CEILING_DBTP).alias("under_ceiling"))


@query("WITH m AS (SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS aim FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_id, coalesce(round(aim - value, 9), 0) AS gain_db FROM events LEFT JOIN m USING (event_type)")
def level_gains(spark, root):
    """Events as clips of a kind with a level."""
    e = table(spark, root, "events").select("event_id", "event_type", F.col("value").alias("level"))
    return frames.level_gains(e, "event_type").select("event_id", F.round("gain_db", 9).alias("gain_db"))


@query(f"SELECT item_id, CAST(96 AS INTEGER) AS n, true AS keeps_level FROM {_CLIPS}")
def resampled_clips(spark, root):
    """Each clip, ten times over, from 2 to 3 kHz: half as long again, with the same mean square inside."""
    c = _clips(spark, root)
    r = frames.resampled(c, "item_id", 2000, 3000).join(c, "item_id")
    return r.select("item_id", F.size("resampled").alias("n"), F.forall("resampled", lambda x: F.abs(x) < 1e3).alias("keeps_level"))


@query(f"SELECT turn_id, CAST(len(r) AS INTEGER) AS same, CAST(0 AS INTEGER) AS other, CAST(0 AS INTEGER) AS missing, CAST(len(h) - len(r) AS INTEGER) AS added FROM (SELECT turn_id, h, list_filter(h, lambda w, i: i % 3 <> 0) AS r FROM (SELECT turn_id, {sql.spoken_tokens('text')} AS h FROM {_TU} WHERE text IS NOT NULL)) WHERE len(r) > 0")
def aligned_words(spark, root):
    """Two of three words of each turn against all of them: the least there is to do is to add the third."""
    t = turns_of(spark, root).where("text is not null").select("turn_id", speech.spoken_tokens("text").alias("h"))
    t = t.withColumn("r", F.filter("h", lambda w, i: (i + 1) % 3 != 0)).where(F.size("r") > 0)
    return t.select("turn_id", frames.alignment("r", "h").alias("a")).select("turn_id", "a.*")


_HEARD = f"""(SELECT p.script_id, p.chunk_no, generate_subscripts(p.pieces, 1) - 1 AS ix, unnest(p.pieces) AS piece FROM planned_chunks p) u JOIN (SELECT script_id, turn, text FROM script_turns QUALIFY row_number() OVER (PARTITION BY script_id, turn ORDER BY ingested_at DESC) = 1) t ON t.script_id = u.script_id AND t.turn = u.piece.turn"""


@query(f"""WITH w AS (SELECT u.script_id, chunk_no, ix, len({sql.words('decode(encode(t.text)[u.piece.text.start + 1:u.piece.text.stop])')}) AS n FROM {_HEARD} WHERE t.text IS NOT NULL)
 SELECT script_id, chunk_no, CAST(row_number() OVER (PARTITION BY script_id, chunk_no ORDER BY ix) - 1 AS INTEGER) AS ix, round((sum(n) OVER (PARTITION BY script_id, chunk_no ORDER BY ix) - n) * CAST(0.4 AS DOUBLE), 6) AS start, round(sum(n) OVER (PARTITION BY script_id, chunk_no ORDER BY ix) * CAST(0.4 AS DOUBLE), 6) AS stop FROM w WHERE n > 0""")
def turn_times(spark, root):
    """The pieces of each planned chunk in a recording that is heard word for word, 0.4 seconds a word."""
    from loomledger.tables import latest

    t = latest(table(spark, root, "script_turns").select("script_id", "turn", "ingested_at", "text"), ["script_id", "turn"]).where("text is not null").select("script_id", "turn", "text")
    p = table(spark, root, "planned_chunks").select("script_id", "chunk_no", F.posexplode("pieces").alias("ix", "p")).select("script_id", "chunk_no", "ix", "p.turn", F.col("p.text.start").alias("a"), F.col("p.text.stop").alias("z"))
    said = p.join(t, ["script_id", "turn"]).withColumn("words", text.words_of(text.byte_slice("text", F.col("a"), F.col("z")))).where(F.size("words") > 0)
    c = said.groupBy("script_id", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "words"))), lambda x: x["words"]).alias("turns"))
    heard = F.transform(F.flatten("turns"), lambda w, i: F.struct(w.alias("word"), (i * 0.4).alias("start"), ((i + 1) * 0.4).alias("stop")))
    c = c.select(F.struct("script_id", "chunk_no").alias("k"), "turns", heard.alias("heard"), (F.size(F.flatten("turns")) * 0.4).alias("secs"))
    return frames.turn_spans(c, "k").select("k.script_id", "k.chunk_no", "ix", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query(f"SELECT turn_id, CAST((3 - turn_id % 3) % 3 AS INTEGER) AS take FROM {_TU} WHERE len({sql.spoken_tokens('text')}) > 3 AND text IS NOT NULL")
def best_takes(spark, root):
    """Turns said by a voice that is understood in one take of three, and tried again until it is."""
    t = turns_of(spark, root).where("text is not null").where(F.size(speech.spoken_tokens("text")) > 3)
    c = t.select(F.col("turn_id").cast("string").alias("chunk_id"), "turn_id", "text", "speaker", F.col("quotes.text").alias("quotes"))

    def speak(df):
        return df.withColumn("heard", F.when((F.col("turn_id") + F.col("take")) % 3 == 0, F.col("text")).otherwise("noise")).withColumn("rate", F.lit(2.0))

    # what is looked for is the take, so quotes that no text holds are left out of the judgement
    own = c.withColumn("quotes", F.lit(None).cast("array<string>"))
    return takes.take_loop(own, speak, F.lit(1)).select(F.col("chunk_id").cast("bigint").alias("turn_id"), F.col("take").cast("int").alias("take"))


@query(f"SELECT turn_id, 'error' AS severity, 'chunk ' || turn_id || ': best take ' || turn_id % 3 || ' has a word error rate of ' || turn_id % 1000 || ' per mille' AS message FROM {_TU} WHERE turn_id % 5 = 0")
def audio_findings(spark, root):
    c = turns_of(spark, root).select(F.col("turn_id").alias("chunk_id"), (F.col("turn_id") % 3).alias("take"), (F.col("turn_id") % 1000).alias("wer_pm"), (F.col("turn_id") % 5 != 0).alias("verified"))
    return verify.findings(c).select(F.col("chunk_id").alias("turn_id"), "severity", "message")


@query(f"SELECT DISTINCT script_id, speaker, CASE WHEN speaker = 'caller' THEN 'no clip' WHEN speaker = 'expert' THEN 'no sound' WHEN speaker = 'anna' THEN 'not the generated clip' END AS problem FROM {_TU}")
def voice_clips(spark, root):
    t = turns_of(spark, root)
    s = F.col("speaker")
    clips = t.select("speaker").distinct().where(s != "caller").select(s, F.concat(F.lit("voices/"), s, F.lit(".wav")).alias("path"), (s != "expert").alias("readable"), F.sha2(s, 256).alias("digest"), F.when(s == "anna", F.lit("0")).when(s == "host", F.sha2(s, 256)).alias("made_as"))
    return frames.cast_clips(t, clips).select("script_id", "speaker", "problem")


@query(f"SELECT item_id, ix, len(y) AS n, round(coalesce(list_sum(y), 0), 5) AS total FROM (SELECT item_id, ix, x[greatest(0, CAST(floor(a * 100) AS INTEGER)) + 1:greatest(0, CAST(floor(z * 100) AS INTEGER))] AS y FROM {_CLIPS} CROSS JOIN (VALUES (0, -0.1, 0.055), (1, 0.2, 0.5), (2, 0.6, 3.0)) s(ix, a, z))")
def cut_clips(spark, root):
    """Three spans of each clip, at 100 samples a second; two of them run over an end."""
    c = _clips(spark, root)
    spans = c.select("item_id", F.posexplode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(z).alias("stop")) for a, z in ((-0.1, 0.055), (0.2, 0.5), (0.6, 3.0))])).alias("ix", "s")).select("item_id", "ix", "s.start", "s.stop")
    y = frames.cut_out(c, spans, "item_id", 100)
    return y.select("item_id", "ix", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


_TURNS_OF = "(SELECT script_id, chunk_no, unnest(list_distinct(list_transform(pieces, lambda p: p.turn))) AS turn FROM planned_chunks)"


@query(f"WITH s AS (SELECT DISTINCT c.script_id, c.chunk_no, c.turn, t.speaker FROM {_TURNS_OF} c JOIN {_TU} t USING (script_id, turn)), l AS (SELECT script_id, chunk_no, max(turn) AS last_ FROM {_TURNS_OF} GROUP BY ALL), b AS (SELECT script_id, chunk_no, lag(last_) OVER (PARTITION BY script_id ORDER BY chunk_no) AS turn FROM l) SELECT script_id, chunk_no, array_to_string(list_sort(list(DISTINCT speaker)), '|') AS speakers FROM (SELECT script_id, chunk_no, speaker FROM s UNION ALL SELECT b.script_id, b.chunk_no, t.speaker FROM b JOIN {_TU} t USING (script_id, turn)) WHERE speaker IS NOT NULL GROUP BY ALL")
def voice_keys(spark, root):
    """The speakers whose voices each planned chunk needs: its own, and that of the turn before it."""
    from loomledger.operators import script

    t = turns_of(spark, root)
    c = table(spark, root, "planned_chunks").select("script_id", "chunk_no", F.array_distinct("pieces.turn").alias("turns"))
    k = F.struct("script_id", "chunk_no").alias("chunk_id")
    own = c.select("script_id", "chunk_no", F.explode("turns").alias("turn")).join(t.select("script_id", "turn", "speaker"), ["script_id", "turn"]).groupBy("script_id", "chunk_no").agg(F.collect_set("speaker").alias("speakers"))
    before = script.context(c, t.select("script_id", "turn", "callback_to")).select("script_id", "chunk_no", F.col("previous").alias("turn")).join(t.select("script_id", "turn", "speaker"), ["script_id", "turn"])
    out = takes.speakers_needed(own.select(k, "speakers"), before.select(k, F.array("speaker").alias("speakers")))
    return out.select("chunk_id.script_id", "chunk_id.chunk_no", bar("speakers").alias("speakers"))


@query(f"SELECT turn_id, array_to_string(list_filter(qs, lambda q, i: contains(text, q) AND list_position(qs, q) = i), '|') AS quotes FROM (SELECT turn_id, text, list_transform(quotes, lambda q: q.text) AS qs FROM {_TU} WHERE text IS NOT NULL AND len(quotes) > 0)")
def chunk_quotes(spark, root):
    t = turns_of(spark, root).where("text is not null and size(quotes) > 0")
    return t.select("turn_id", bar(takes.spoken_quotes(F.col("text"), F.col("quotes.text"))).alias("quotes"))


_BY, _AT = "CASE WHEN turn_id % 2 = 0 THEN speaker ELSE 'somebody' END", "CASE turn_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'over' END"


def _sounds(t):
    """A sound for each turn, half of them by somebody else."""
    k = F.col("turn_id") % 3
    return t.withColumn("by", F.when(F.col("turn_id") % 2 == 0, F.col("speaker")).otherwise("somebody")).withColumn("at", F.when(k == 0, "before").when(k == 1, "after").otherwise("over")).withColumn("kind", F.when(F.col("turn_id") % 5 == 0, "laugh").otherwise("backchannel"))


@query(f"""WITH t AS (SELECT script_id, turn, turn_id, speaker, {_BY} AS by_, {_AT} AS at_ FROM {_TU}), p AS (SELECT piece_id, script_id, turn, row_number() OVER w = 1 AS starts, row_number() OVER (PARTITION BY script_id, turn ORDER BY text.start DESC, piece_id DESC) = 1 AS ends FROM {sql.latest('pieces', 'piece_id')} WINDOW w AS (PARTITION BY script_id, turn ORDER BY text.start, piece_id))
 SELECT p.piece_id, CASE WHEN by_ = speaker AND ((at_ = 'before' AND starts) OR (at_ = 'after' AND ends)) THEN at_ ELSE '' END AS sounds FROM p JOIN t USING (script_id, turn)""")
def spoken_pieces(spark, root):
    """What is said with each piece of a turn: sounds by the turn's speaker, before its first and after its last piece."""
    from pyspark.sql.window import Window

    from loomledger.plans.register import pieces_of

    t = _sounds(turns_of(spark, root).select("script_id", "turn", "turn_id", "speaker"))
    w = Window.partitionBy("script_id", "turn")
    p = pieces_of(spark, root).select("script_id", "turn", F.col("piece_id").alias("piece"), F.col("text.start").alias("a"))
    p = p.withColumn("starts", F.row_number().over(w.orderBy("a", "piece")) == 1).withColumn("ends", F.row_number().over(w.orderBy(F.desc("a"), F.desc("piece"))) == 1)
    out = frames.spoken(p.join(t.select("script_id", "turn", "speaker"), ["script_id", "turn"]), t)
    return out.select(F.col("piece").alias("piece_id"), bar(F.transform("sounds", lambda s: s["at"])).alias("sounds"))


@query(f"SELECT by_ AS speaker, 'mm ' || turn_id % 4 AS text, count(DISTINCT (turn_id, at_)) AS n_places FROM (SELECT turn_id, speaker, {_BY} AS by_, {_AT} AS at_ FROM {_TU}) WHERE (at_ = 'over' OR by_ <> speaker) AND turn_id % 5 <> 0 GROUP BY ALL")
def overlay_clips(spark, root):
    """The sounds for the second track, each of a speaker made once."""
    t = _sounds(turns_of(spark, root).select("turn_id", F.col("speaker").alias("turn_speaker"), "speaker")).withColumn("text", F.concat(F.lit("mm "), (F.col("turn_id") % 4).cast("string")))
    return takes.overlays(t.drop("speaker")).select("speaker", "text", F.size("places").cast("bigint").alias("n_places"))


@query(f"SELECT script_id, true AS fits, count(*) AS n_turns FROM {_TU} GROUP BY script_id")
def turn_packs(spark, root):
    """Turns packed to 60 seconds with half a second between them: no pack of several turns is longer, and none could take the turn after it."""
    t = turns_of(spark, root).select("script_id", "turn", frames.seconds(text.word_count(F.coalesce("text", F.lit("")))).alias("secs"))
    p = frames.turn_packs(t, 60.0, 0.5).join(t, ["script_id", "turn"]).groupBy("script_id", "pack").agg(F.count("*").alias("n"), F.sum("secs").alias("s"), F.min_by("secs", "turn").alias("first"))
    after = p.select("script_id", (F.col("pack") - 1).alias("pack"), F.col("first").alias("next"))
    length = F.col("s") + (F.col("n") - 1) * 0.5
    fits = ((F.col("n") == 1) | (length <= 60.0 + 1e-9)) & F.coalesce(length + 0.5 + F.col("next") > 60.0 - 1e-9, F.lit(True))
    return p.join(after, ["script_id", "pack"], "left").groupBy("script_id").agg(F.bool_and(fits).alias("fits"), F.sum("n").alias("n_turns"))


@query(f"SELECT turn_id, CAST(CAST('0x' || substr({sql.content_id('turn_id', '2')}, 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM {_TU}")
def take_seeds(spark, root):
    return turns_of(spark, root).select("turn_id", takes.seed(F.col("turn_id"), F.lit(2)).cast("string").alias("seed"))


@query("SELECT event_type AS backend, round(avg((1 + event_id % 7) / (10 + event_id % 13)), 9) AS rtf_mean, round(max((1 + event_id % 7) / (10 + event_id % 13)), 9) AS rtf_max, round(avg((event_id % 11) / 100.0), 9) AS wer_mean, round(sum(event_id % 3) / sum(2), 9) AS quotes_heard FROM events GROUP BY event_type")
def bake_off(spark, root):
    """Events as runs of a backend."""
    i = F.col("event_id")
    r = table(spark, root, "events").select(F.col("event_type").alias("backend"), (10 + i % 13).alias("secs"), (1 + i % 7).alias("took"), ((i % 11) / 100.0).alias("wer"), F.lit(2).alias("quotes"), (i % 3).alias("quotes_heard"), F.lit(1.0).alias("similarity"))
    return frames.bake_off(r).select("backend", *[F.round(c, 9).alias(c) for c in ("rtf_mean", "rtf_max", "wer_mean", "quotes_heard")])


_SEGS = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ix FROM events"


@query(f"""WITH s AS (SELECT user_id, event_id, ix, ix * 1.0 - CASE WHEN event_id % 9 = 0 THEN 0.5 ELSE 0 END AS start, CASE WHEN event_id % 31 = 0 THEN NULL ELSE ix * 1.0 + CASE WHEN event_id % 17 = 0 THEN -1 ELSE 0.9 END END AS stop FROM ({_SEGS})), b AS (SELECT *, lag(stop) OVER (PARTITION BY user_id ORDER BY ix) AS before FROM s)
 SELECT user_id, event_id FROM b WHERE stop IS NULL OR stop < start OR start < 0 OR stop > 100.02 OR coalesce(before > start + 0.02, false)""")
def bad_segments(spark, root):
    """Events as segments that a recogniser heard, some of them impossible."""
    from pyspark.sql.window import Window

    i = F.col("event_id")
    s = table(spark, root, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("ix"))
    start = F.col("ix") * 1.0 - F.when(i % 9 == 0, 0.5).otherwise(0.0)
    stop = F.when(i % 31 != 0, F.col("ix") * 1.0 + F.when(i % 17 == 0, -1.0).otherwise(0.9))
    rows = s.select("user_id", "event_id", "ix", start.alias("start"), stop.alias("stop"), F.lit(100.0).alias("length"))
    return verify.bad_segments(rows, "user_id").select("user_id", "event_id")


_UNIT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"SELECT a.vec_id % 7 AS speaker, count(*) AS n, round(avg({_UNIT}), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 7 WHERE a.vec_id % 5 >= {bench.LEAST_SECS} GROUP BY 1")
def voice_similarity(spark, root):
    """Vectors as segments of seven speakers, the first seven as their voices."""
    e = table(spark, root, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    segments = e.select((F.col("vec_id") % 7).alias("speaker"), (F.col("vec_id") % 5).cast("double").alias("secs"), "vec")
    out = frames.voice_similarity(segments, e.where("vec_id < 7").select(F.col("vec_id").alias("speaker"), "vec"))
    return out.select("speaker", "n", F.round("similarity", 6).alias("similarity"))



#: Names for the lexicon's queries: what is said for each, and how a recogniser hears some of them.
_SAY = {"harbour": "HAR-bur", "council": "KOWN-sil", "lighthouse": "LITE-house", "the surveyor": "the sur-VAY-er"}
_HEARD_AS = {"Lockkeeper": ["the lock keeper"], "Lastly": ["as", "even so"]}
_ANY = r"\b(?:the surveyor|lighthouse|council|harbour)\b"


@query(f"SELECT doc_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '|') AS names FROM (SELECT doc_id, regexp_extract_all(replace(text, '_', ' '), '{_ANY}') AS n FROM documents WHERE lang = 'en' AND text IS NOT NULL) WHERE len(n) > 0")
def names_in_texts(spark, root):
    """Names in English documents, each once, by their first place."""
    d = table(spark, root, "documents").where("lang = 'en' and text is not null")
    return d.select("doc_id", bar(speech.names_in("text", list(_SAY))).alias("names")).where("names <> ''")


def _said_in_sql() -> str:
    out = "text"
    for name, say in sorted(_SAY.items(), key=lambda p: -len(p[0])):
        out = rf"regexp_replace({out}, '\b{name}\b', '{say}', 'g')"
    return out


@query(f"SELECT turn_id, sha256({_said_in_sql()}) AS digest FROM {_TU} WHERE regexp_matches(text, '{_ANY}')")
def respelled_turns(spark, root):
    return turns_of(spark, root).select("turn_id", speech.respell("text", _SAY).alias("said")).where("said is not null").select("turn_id", F.sha2("said", 256).alias("digest"))


_ONCE = r"replace(replace(replace({0}, '|the|lock|keeper|', '|lockkeeper|'), '|even|so|', '|lastly|'), '|as|', '|lastly|')"


@query(f"SELECT turn_id, trim({_ONCE.format(_ONCE.format('h'))}, '|') AS heard FROM (SELECT turn_id, '|' || array_to_string({sql.spoken_tokens('text')}, '|') || '|' AS h FROM {_TU} WHERE text IS NOT NULL)")
def heard_variants(spark, root):
    """Turns as they are misheard, with the names put back."""
    t = turns_of(spark, root).where("text is not null")
    return t.select("turn_id", bar(speech.hear(speech.spoken_tokens("text"), _HEARD_AS)).alias("heard"))


@query("SELECT script_id, array_to_string(list_sort(list_transform(map_entries(map_concat(MAP {'a': 'base', 'b': coalesce(backend, '')}, MAP {'b': 'over', 'c' || script_id % 3: 'own'})), lambda e: e.key || ':' || e.value)), '|') AS lexicon FROM scripts")
def merged_lexicons(spark, root):
    """A lexicon of all scripts under one of each."""
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.coalesce("backend", F.lit("")))
    over = F.create_map(F.lit("b"), F.lit("over"), F.concat(F.lit("c"), (F.col("script_id") % 3).cast("string")), F.lit("own"))
    m = table(spark, root, "scripts").select("script_id", speech.merge_lexicons(base, over).alias("m"))
    return m.select("script_id", bar(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))).alias("lexicon"))


@query("SELECT event_id, least(CASE WHEN event_id % 3 > 0 THEN event_id % 50 END, CASE WHEN event_id % 4 > 0 THEN event_id % 70 END) AS cap FROM events")
def output_caps(spark, root):
    """The lower of a run's and a stage's cap; one that is missing does not bind."""
    from loomledger.operators import script

    i = F.col("event_id")
    return table(spark, root, "events").select("event_id", script.output_cap(F.when(i % 3 > 0, i % 50), F.when(i % 4 > 0, i % 70)).alias("cap"))
