"""Queries of the operators on drafts: placeholders, references, hints, whole builds, verdicts, stances and the checks around them. Drafts are made of the tables' rows, with every kind of mistake among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.config import DEFAULT
from loomledger.functions import text
from loomledger.operators import adjudicate, analyse, ledger, references, script, stances, vectors, windows
from loomledger.plans import sql
from loomledger.plans.register import chunks_of, query, turns_of
from loomledger.tables import table

_TU, _CH = sql.latest("script_turns", "turn_id"), sql.latest("chunks", "chunk_id")


@query(f"""SELECT turn_id, CASE turn_id % 7 WHEN 0 THEN 'Look “' || sha || '” there' WHEN 6 THEN 'No quote' END AS ok, CASE turn_id % 7 WHEN 1 THEN 'malformed' WHEN 2 THEN 'typed' WHEN 3 THEN 'unclosed' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unused' END AS error, CAST(CASE turn_id % 7 WHEN 4 THEN 3 WHEN 5 THEN 1 END AS INTEGER) AS index FROM (SELECT turn_id, md5(CAST(turn_id AS VARCHAR)) AS sha FROM {_TU})""")
def filled_placeholders(spark, root):
    """Drafts of seven kinds: two that can be filled, and one for each mistake."""
    t = turns_of(spark, root).select("turn_id", F.md5(F.col("turn_id").cast("string").cast("binary")).alias("q"))
    k = F.col("turn_id") % 7
    draft = F.when(k == 0, 'Look "{{quote:0}}" there').when(k == 1, "Look {{quote:x}} there").when(k == 2, 'Look "one two three" {{quote:0}}').when(k == 3, 'Look {{quote:0}} "there').when(k == 4, "Look {{quote:0}} {{quote:3}}").when(k == 5, "Look {{quote:0}}").otherwise("No quote")
    quotes = F.when(k == 6, F.array().cast("array<string>")).when(k == 5, F.array("q", "q")).otherwise(F.array("q"))
    return t.select("turn_id", script.fill_quotes(draft, quotes).alias("f")).select("turn_id", "f.ok", "f.error", "f.index")


_REFS = [(0, 0, None), (1, 999_999, None), (2, 0, "~~nowhere~~")]


@query(f"""WITH text_rows AS (SELECT chunk_id AS k, text AS t FROM {_CH}), {sql.SPANS}, f AS (SELECT k, sentence, start FROM spans WHERE sent_ix = 0)
 SELECT c.chunk_id, r.ix AS ref_ix, CAST(CASE WHEN r.ix = 0 THEN f.start + c.span.start END AS BIGINT) AS start, CAST(CASE WHEN r.ix = 0 THEN f.start + c.span.start + octet_length(encode(f.sentence)) END AS BIGINT) AS stop, CASE r.ix WHEN 1 THEN 'no such sentence' WHEN 2 THEN 'not in that sentence' WHEN 3 THEN 'no such source' END AS error FROM {_CH} c JOIN f ON f.k = c.chunk_id CROSS JOIN (VALUES (0), (1), (2), (3)) r(ix)""")
def resolved_references(spark, root):
    """Four references to each chunk: its first sentence, one it has not, words that are not in it, and a source that there is not."""
    c = chunks_of(spark, root).select(F.col("chunk_id").alias("source_no"), "doc_id", F.col("span.start").alias("start"), "text")
    src = references.numbered(c)
    some = src.where("sent_no = 0").select(F.col("source_no").alias("own"))
    rows = F.array(*[F.struct(F.lit(i).alias("ref_ix"), F.col("own").alias("source_no"), F.lit(n).alias("sent_no"), F.lit(p).cast("string").alias("part")) for i, n, p in _REFS], F.struct(F.lit(3).alias("ref_ix"), F.concat(F.lit("-"), "own").alias("source_no"), F.lit(0).alias("sent_no"), F.lit(None).cast("string").alias("part")))
    refs = some.select(F.col("own").alias("script_id"), F.lit(0).alias("turn"), F.explode(rows).alias("r")).select("script_id", "turn", "r.*")
    out = references.resolve(refs, src)
    return out.select(F.col("script_id").alias("chunk_id"), "ref_ix", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), "error")


_Q = r"""list_filter(list_transform(list_filter(regexp_extract_all(sentence, '"[^"]*("|\z)|“[^”]*(”|\z)'), lambda q: length(q) > 1 AND ((q[1] = '"' AND q[-1] = '"') OR (q[1] = '“' AND q[-1] = '”'))), lambda q: substr(q, 2, length(q) - 2)), lambda q: len(""" + sql.words("q") + ") >= 3)"


@query(f"""WITH text_rows AS (SELECT chunk_id AS k, text AS t FROM {_CH}), {sql.SPANS}, q AS (SELECT k, sent_ix, unnest({_Q}) AS q FROM spans), h AS (SELECT DISTINCT q AS full_, CASE WHEN length(q) > 12 THEN left(q, 12) || '…' ELSE q END AS typed FROM q)
 SELECT full_ AS key, arg_min(q.k, (q.k, q.sent_ix)) AS chunk_id, arg_min(q.sent_ix, (q.k, q.sent_ix)) AS sent_no FROM h JOIN q ON q.q = h.typed OR (h.typed LIKE '%…' AND starts_with(q.q, left(h.typed, length(h.typed) - 1))) GROUP BY full_""")
def quotation_hints(spark, root):
    """Where each quotation of the chunks is first found by its beginning."""
    c = chunks_of(spark, root).select(F.col("chunk_id").alias("source_no"), "doc_id", F.col("span.start").alias("start"), "text")
    src = references.numbered(c)
    full = src.select(F.explode("quoted").alias("key")).distinct()
    typed = full.withColumn("typed", F.when(F.char_length("key") > 12, F.concat(F.left("key", F.lit(12)), F.lit("…"))).otherwise(F.col("key")))
    return references.hints(typed, src).select("key", F.col("source_no").alias("chunk_id"), "sent_no")


@query(f"SELECT script_id, CASE script_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no such source' WHEN 2 THEN 'placeholder: unused' ELSE 'unknown claim zz' END AS error, CAST(CASE WHEN script_id % 4 = 0 THEN 2 END AS BIGINT) AS n_turns FROM scripts")
def built_scripts(spark, root):
    """Two turns for each script, three scripts of four with a mistake in the second turn."""
    src = references.numbered(table(spark, root, "documents").where("text is not null").orderBy("doc_id").limit(1).select(F.lit(0).alias("source_no"), "doc_id", F.lit(0).alias("start"), F.lit("It was so. It went on.").alias("text")))
    s = table(spark, root, "scripts").select("script_id")
    k = F.col("script_id") % 4
    ref = lambda n: F.struct(F.lit(n).alias("source_no"), F.lit(0).alias("sent_no"), F.lit(None).cast("string").alias("part"))
    none = F.array().cast("array<struct<source_no:int,sent_no:int,part:string>>")
    no_text = F.array().cast("array<string>")
    first = s.select("script_id", F.lit(0).alias("turn"), F.lit("host").alias("speaker"), F.lit("So {{quote:0}}").alias("text"), no_text.alias("citations"), F.array(ref(0)).alias("refs"))
    second = s.select("script_id", F.lit(1), F.lit("guest"), F.when(k == 1, "And {{quote:0}}").otherwise("Indeed."), F.when(k == 3, F.array(F.lit("zz"))).otherwise(no_text), F.when(k == 1, F.array(ref(9))).when(k == 2, F.array(ref(0))).otherwise(none))
    turns, errors = references.build(first.union(second), src, table(spark, root, "claims"))
    return s.join(errors.select("script_id", "error"), "script_id", "left").join(turns.groupBy("script_id").agg(F.count("*").alias("n_turns")), "script_id", "left")


_KIND = "(CAST(('0x' || claim_id[1:4]) AS INTEGER) % 8)"
_HAS = "len(list_filter(evidence, lambda e: e.stance = '{}')) > 0"
_CITED = "len(list_filter(cites, lambda i: evidence[i + 1].stance = '{}')) > 0"


@query(f"""WITH v AS (SELECT claim_id, evidence, k, CASE k WHEN 1 THEN [99] WHEN 2 THEN [] ELSE range(0, len(evidence)) END AS cites, CASE k WHEN 3 THEN 'supporting' WHEN 4 THEN 'nobody' WHEN 7 THEN 'contradicting' ELSE 'unresolved' END AS favours FROM (SELECT claim_id, evidence, {_KIND} AS k FROM claims WHERE len(evidence) > 0)),
 p AS (SELECT claim_id, CASE WHEN k = 1 THEN 'cites out of range' WHEN {_HAS.format('supports')} AND NOT {_CITED.format('supports')} THEN 'a supporting side is not cited' WHEN {_HAS.format('contradicts')} AND NOT {_CITED.format('contradicts')} THEN 'a contradicting side is not cited'
 WHEN favours = 'supporting' AND NOT {_HAS.format('supports')} THEN 'favours a side without evidence' WHEN favours = 'contradicting' AND NOT {_HAS.format('contradicts')} THEN 'favours a side without evidence' WHEN favours = 'nobody' THEN 'unknown side' WHEN k = 5 THEN 'explanation too long' WHEN k = 6 THEN 'explanation quotes' END AS problem FROM v) SELECT * FROM p WHERE problem IS NOT NULL""")
def invalid_verdicts(spark, root):
    """A verdict on each claim, seven of eight with something to find."""
    c = table(spark, root, "claims").where("size(evidence) > 0").select("claim_id", "evidence")
    k = F.conv(F.substring("claim_id", 1, 4), 16, 10).cast("int") % 8
    every = F.sequence(F.lit(0), F.size("evidence") - 1)
    v = c.select("claim_id", F.when(k == 3, "supporting").when(k == 4, "nobody").when(k == 7, "contradicting").otherwise("unresolved").alias("favours"), F.when(k == 5, F.repeat(F.lit("x"), 601)).when(k == 6, 'so "said"').otherwise("fine").alias("explanation"), F.when(k == 1, F.array(F.lit(99))).when(k == 2, F.array().cast("array<int>")).otherwise(every).alias("cites"))
    return adjudicate.invalid_verdicts(v, c)


@query("""WITH j AS (SELECT claim, label, item_id, CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 2 = 1 THEN 'supports' ELSE 'contradicts' END AS stance, item_id % 5 + 800 AS pm, row_number() OVER (PARTITION BY claim, label ORDER BY item_id) AS rank FROM stance_pairs)
 SELECT claim, label, item_id, stance FROM j WHERE stance IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim, label ORDER BY (stance = 'supports') DESC, pm DESC, rank) = 1""")
def deciding_windows(spark, root):
    """Of the pairs of a claim and a label, the one that decides."""
    from pyspark.sql.window import Window

    i = F.col("item_id")
    p = table(spark, root, "stance_pairs").select(F.col("claim").alias("claim_id"), F.col("label").alias("chunk_id"), "item_id", F.when(i % 4 == 0, None).when(i % 2 == 1, "supports").otherwise("contradicts").alias("stance"), (i % 5 + 800).alias("entail_pm"), (i % 5 + 800).alias("contra_pm"), F.row_number().over(Window.partitionBy("claim", "label").orderBy("item_id")).alias("rank"))
    return stances.deciding(p).select(F.col("claim_id").alias("claim"), F.col("chunk_id").alias("label"), "item_id", "stance")


@query(f"""WITH c AS (SELECT claim_id, list_distinct(list_transform(evidence, lambda e: {sql.fold('e.independence_group')})) AS gs, {sql.slots(sql.content_words('text'))} AS s FROM claims), d AS (SELECT c.chunk_id, {sql.fold('d.source_ref.independence_group')} AS g, {sql.slots(sql.content_words('c.text'))} AS s FROM {_CH} c JOIN documents d USING (doc_id)),
 qc AS (SELECT claim_id, s, count(*) AS n FROM (SELECT claim_id, unnest(s) AS s FROM c) GROUP BY ALL), q2 AS (SELECT claim_id, sum(n * n) AS q FROM qc GROUP BY ALL), dc AS (SELECT chunk_id, s, count(*) AS n FROM (SELECT chunk_id, unnest(s) AS s FROM d) GROUP BY ALL), d2 AS (SELECT chunk_id, sum(n * n) AS q FROM dc GROUP BY ALL),
 dots AS (SELECT claim_id, chunk_id, sum(qc.n * dc.n) AS dot FROM qc JOIN dc USING (s) GROUP BY ALL), sims AS (SELECT claim_id, chunk_id, {sql.per_mille('dot / sqrt(CAST(q2.q * d2.q AS DOUBLE))')} AS sim_pm FROM dots JOIN q2 USING (claim_id) JOIN d2 USING (chunk_id) JOIN c USING (claim_id) JOIN d USING (chunk_id) WHERE NOT coalesce(list_contains(gs, g), false))
 SELECT claim_id, rank, sim_pm FROM (SELECT claim_id, sim_pm, row_number() OVER (PARTITION BY claim_id ORDER BY sim_pm DESC) AS rank FROM sims WHERE sim_pm >= 300) WHERE rank <= 4""")
def topk_other_groups(spark, root):
    """The four passages most like each claim among those of groups that its evidence does not come from."""
    d = table(spark, root, "documents").select("doc_id", text.fold_group("source_ref.independence_group").alias("grp"))
    of_chunk = chunks_of(spark, root).select("doc_id", F.xxhash64("chunk_id").alias("id"), F.xxhash64("chunk_id").alias("ord"), vectors.slots_of("text").alias("vec"))
    c = of_chunk.join(d, "doc_id").select("id", "ord", "vec", "grp")  # slots are fewer bytes to shuffle than texts
    q = table(spark, root, "claims").select("claim_id", F.xxhash64("claim_id").alias("id"), vectors.slots_of("text").alias("vec"), F.array_distinct(F.transform("evidence", lambda e: text.fold_group(e["independence_group"]))).alias("grp"))
    best = vectors.top_k(q.select("id", "vec", "grp"), c, DEFAULT.retrieve_k, DEFAULT.retrieve_floor_pm)
    return best.join(q.select(F.col("id").alias("qid"), "claim_id"), "qid").select("claim_id", "rank", "sim_pm")


@query(f"SELECT severity, count(*) AS n FROM (SELECT CASE WHEN coalesce(len(citations), 0) = 0 THEN 'warning' ELSE 'error' END AS severity FROM {_TU} WHERE text IS NOT NULL AND regexp_matches(text, '[0-9]')) GROUP BY severity")
def finding_counts(spark, root):
    """Turns with a digit as findings: errors where they cite a claim, else warnings."""
    f = turns_of(spark, root).where("text is not null").where(F.col("text").rlike("[0-9]")).select(F.when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, "warning").otherwise("error").alias("severity"))
    return analyse.by_severity(f)


@query("SELECT count(*) AS runs, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END), 9) AS pass_rate, round(avg(CASE WHEN value > 10 AND event_id % 3 = 0 THEN 1.0 ELSE 0 END), 9) AS first_try_rate, round(avg(CASE WHEN value > 10 THEN (event_id % 10) / 10.0 END), 9) AS word_ratio, round(avg(CASE WHEN value > 10 THEN (event_id % 4) / 4.0 END), 9) AS coverage FROM events WHERE value IS NOT NULL")
def eval_summary(spark, root):
    """Events as runs of an evaluation."""
    i = F.col("event_id")
    r = table(spark, root, "events").where("value is not null").select((F.col("value") > 10).alias("passed"), (i % 3 + 1).alias("attempts"), ((i % 10) / 10.0).alias("word_ratio"), ((i % 4) / 4.0).alias("coverage"))
    return references.summary(r).select("runs", *[F.round(c, 9).alias(c) for c in ("pass_rate", "first_try_rate", "word_ratio", "coverage")])


@query(f"""WITH v AS (SELECT e.claim_id, e.ix, e.k, c.text AS chunk_text, d.text AS doc_text FROM (SELECT claim_id, generate_subscripts(evidence, 1) - 1 AS ix, {_KIND} % 3 AS k, unnest(evidence).chunk AS chunk_id FROM claims) e JOIN {_CH} c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id)
 SELECT claim_id, ix AS ev_ix, CASE k WHEN 0 THEN CASE WHEN octet_length(encode(doc_text)) > 0 AND ord(doc_text[1]) < 128 THEN left(doc_text, 1) END WHEN 1 THEN 'as ' || claim_id ELSE chunk_text END AS passage FROM v WHERE doc_text IS NOT NULL""")
def evidence_passages(spark, root):
    """What a judge is shown of evidence on every basis: the first byte of the document as a premise, another wording, or the whole chunk."""
    k = F.conv(F.substring("claim_id", 1, 4), 16, 10).cast("int") % 8 % 3
    c = table(spark, root, "claims").withColumn("k", k)
    basis = lambda: F.struct(F.when(F.col("k") == 0, "nli").when(F.col("k") == 1, "merged").otherwise("plain").alias("kind"), F.concat(F.lit("as "), "claim_id").alias("wording"), F.struct(F.lit(0).alias("start"), F.lit(1).alias("stop")).alias("premise"))
    e = c.select("claim_id", F.transform("evidence", lambda x: F.struct(x["chunk"].alias("chunk"), x["stance"].alias("stance"), basis().alias("basis"))).alias("evidence"))
    docs = table(spark, root, "documents").where("text is not null")
    known = chunks_of(spark, root).join(docs.select("doc_id"), "doc_id", "left_semi")
    out = adjudicate.passages(e, known, docs.select("doc_id", "title", "text"))
    held = e.select("claim_id", F.posexplode("evidence.chunk").alias("ev_ix", "chunk_id")).join(known.select("chunk_id"), "chunk_id", "left_semi").select("claim_id", "ev_ix")
    return out.join(held, ["claim_id", "ev_ix"]).select("claim_id", "ev_ix", "passage")


@query("SELECT claim_id, octet_length(encode(to_json({text: text, id: claim_id}))) > 200 AS large FROM claims")
def large_requests(spark, root):
    """Claims whose request is longer than 200 bytes."""
    c = table(spark, root, "claims").select("claim_id", "text", F.col("claim_id").alias("id"))
    big = script.oversized_requests(c, "claim_id", "text", "id", limit=200)
    return c.join(big, "claim_id", "left").select("claim_id", F.col("bytes").isNotNull().alias("large"))


@query(f"SELECT claim_id, status FROM {sql.LEDGER} WHERE status <> 'unsupported'")
def usable_claims(spark, root):
    return ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status <> 'unsupported'").select("claim_id", "status")


@query(f"SELECT chunk_id, count(*) AS n FROM (WITH text_rows AS (SELECT chunk_id AS k, text AS t FROM {_CH}), {sql.SPANS} SELECT k AS chunk_id FROM spans) GROUP BY chunk_id")
def sentences_of_chunks(spark, root):
    return windows.sentence_spans(chunks_of(spark, root), "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT script_id, turn, quotes, row_number() OVER (PARTITION BY script_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY script_id) AS n, min(turn) OVER (PARTITION BY script_id) AS first_ FROM {_TU})
 SELECT script_id, turn, CASE WHEN r = n THEN 'transition' WHEN r = 1 THEN CASE WHEN len(quotes) > 0 THEN 'quote_reading' ELSE 'narration' END WHEN r = 2 THEN 'banter' END AS mark, CASE WHEN r = n THEN 'long_pause' WHEN r = 2 THEN 'quick' ELSE 'normal' END AS pace, CAST(CASE WHEN r = 2 AND n > 2 THEN 1 ELSE 0 END AS INTEGER) AS n_sounds, CASE WHEN r = n THEN first_ END AS callback_to FROM r""")
def directed_scripts(spark, root):
    """The directions of the stand-in writer for every script."""
    d = script.directed(turns_of(spark, root).select("script_id", "turn", "quotes"))
    return d.select("script_id", "turn", "mark", "pace", F.size("sounds").alias("n_sounds"), "callback_to")


@query(f"""WITH t AS (SELECT p.script_id, p.chunk_no, list_distinct(list_transform(p.pieces, lambda x: x.turn)) AS turns FROM planned_chunks p), c AS (SELECT script_id, chunk_no, turns, lag(list_max(turns)) OVER (PARTITION BY script_id ORDER BY chunk_no) AS previous FROM t),
 b AS (SELECT c.script_id, c.chunk_no, list(DISTINCT u.callback_to) AS called FROM (SELECT script_id, chunk_no, unnest(turns) AS turn FROM c) c JOIN {_TU} u USING (script_id, turn) WHERE u.callback_to IS NOT NULL GROUP BY ALL)
 SELECT c.script_id, c.chunk_no, coalesce(array_to_string(list_sort(list_filter(b.called, lambda x: NOT list_contains(c.turns, x) AND x IS DISTINCT FROM c.previous)), '|'), '') AS called FROM c LEFT JOIN b USING (script_id, chunk_no)""")
def called_back(spark, root):
    """The turns that a planned chunk calls back to and has not just heard."""
    c = table(spark, root, "planned_chunks").select("script_id", "chunk_no", F.array_distinct("pieces.turn").alias("turns"))
    out = script.context(c, turns_of(spark, root).select("script_id", "turn", "callback_to"))
    return out.select("script_id", "chunk_no", F.array_join(F.transform("called", lambda x: x.cast("string")), "|").alias("called"))
