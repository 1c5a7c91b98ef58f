"""The queries of the ledger engine and the SQL that each is checked against.

Arrays are joined with '|' where a result holds them, so that both engines print one form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomledger.config import DEFAULT
from loomledger.functions import speech, text
from loomledger.operators import adjudicate, analyse, claims, cluster, ground, ledger, prepare, ranking, references, script, stances, vectors, windows
from loomledger.operators.audio import plan, verify
from loomledger.plans import sql
from loomledger.plans.register import QUERIES, SQL, Query, bar, query
from loomledger.plans.register import chunks_of as _chunks
from loomledger.plans.register import pieces_of as _pieces
from loomledger.plans.register import turns_of as _turns
from loomledger.tables import table


_CH, _TU, _PI = sql.latest("chunks", "chunk_id"), sql.latest("script_turns", "turn_id"), sql.latest("pieces", "piece_id")
_NORM = r"replace(replace(regexp_replace(text, '^\x{FEFF}+', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


# documents -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({_NORM}) AS digest, octet_length(encode({_NORM})) AS n_bytes FROM documents WHERE text IS NOT NULL")
def normalise_text(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", text.normalise_text("text").alias("t")).select("doc_id", F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("bigint").alias("n_bytes"))


@query(f"SELECT doc_id, octet_length(encode(t)) AS n_bytes FROM (SELECT doc_id, {_NORM} AS t, source_ref.independence_group AS g FROM documents WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY g, t ORDER BY doc_id) = 1")
def dedup_within_group(spark, root):
    return prepare.dedup_within_group(table(spark, root, "documents").select("doc_id", "text", "source_ref"), "source_ref.independence_group").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query(f"SELECT doc_id, {sql.content_id('source_ref.connector', 'source_ref.locator', 'text')} AS document_id, {sql.content_id('source_ref.connector', 'source_ref.locator')} AS source_id FROM documents")
def document_ids(spark, root):
    s = F.col("source_ref")
    return table(spark, root, "documents").select("doc_id", prepare.document_id(s["connector"], s["locator"], F.col("text")).alias("document_id"), prepare.source_id(s["connector"], s["locator"]).alias("source_id"))


@query("SELECT doc_id // 2 AS doc_id, count(DISTINCT (coalesce(source_ref.connector, ''), coalesce(source_ref.locator, ''), coalesce(source_ref.independence_group, ''))) AS n_sources FROM documents GROUP BY 1 HAVING n_sources > 1")
def shared_document_ids(spark, root):
    """Two documents after each other are given one id."""
    return prepare.shared_ids(table(spark, root, "documents").select(F.floor(F.col("doc_id") / 2).alias("doc_id"), "source_ref"))


#: Lines with their byte places, the state of the fence behind each, and what each is to a chunk: 0 blank, 1 text, 2 heading; then one fold for the chunks.
_LINES = rf"""WITH l0 AS (SELECT doc_id, i, ls[i] AS line, CAST(coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: octet_length(encode(x)) + 1)), 0) AS BIGINT) AS at_ FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
 l1 AS (SELECT *, regexp_replace(line, '{text.WS}+$', '') AS body FROM l0), l2 AS (SELECT *, regexp_replace(body, '^{text.WS}+', '') AS bare FROM l1),
 f AS (SELECT doc_id, list_reduce(list_transform(list(left(bare, 3) ORDER BY i), lambda m: [m]), lambda acc, x: list_append(acc, CASE WHEN x[1] NOT IN ('```', '~~~') THEN acc[-1] WHEN acc[-1] = '' THEN x[1] WHEN acc[-1] = x[1] THEN '' ELSE acc[-1] END), ['']) AS fence FROM l2 GROUP BY doc_id),
 l3 AS (SELECT l2.*, CASE WHEN f.fence[i + 1] = '' AND regexp_matches(body, '^#{{1,6}} ') THEN 2 WHEN bare = '' THEN 0 ELSE 1 END AS k FROM l2 JOIN f USING (doc_id)),
 l4 AS (SELECT doc_id, i, k, body, at_ + octet_length(encode(body)) - octet_length(encode(bare)) AS a, at_ + octet_length(encode(body)) AS z, CAST(len({sql.words('body')}) AS BIGINT) AS w FROM l3),
 h AS (SELECT doc_id, list({{i: i, level: length(regexp_extract(body, '^(#+) ', 1)), title: {sql.trim("regexp_replace(body, '^#+ ', '')")}}} ORDER BY i) AS hs FROM l4 WHERE k = 2 GROUP BY doc_id),
 c AS (SELECT doc_id, list_reduce(list({{k: k, a: a, z: z, w: w, f: i, done: CAST([] AS STRUCT(a BIGINT, z BIGINT, f BIGINT)[])}} ORDER BY i), lambda s, x: CASE WHEN x.k <> 1 AND s.a >= 0 AND (x.k = 2 OR s.w >= 800) THEN {{k: 0, a: CAST(-1 AS BIGINT), z: CAST(0 AS BIGINT), w: CAST(0 AS BIGINT), f: CAST(0 AS BIGINT), done: list_append(s.done, {{a: s.a, z: s.z, f: s.f}})}}
  WHEN x.k = 1 THEN {{k: 0, a: CASE WHEN s.a < 0 THEN x.a ELSE s.a END, z: x.z, w: s.w + x.w, f: CASE WHEN s.a < 0 THEN x.f ELSE s.f END, done: s.done}} ELSE s END, {{k: 0, a: CAST(-1 AS BIGINT), z: CAST(0 AS BIGINT), w: CAST(0 AS BIGINT), f: CAST(0 AS BIGINT), done: CAST([] AS STRUCT(a BIGINT, z BIGINT, f BIGINT)[])}}) AS s FROM l4 GROUP BY doc_id),
 o AS (SELECT doc_id, CASE WHEN s.a >= 0 THEN list_append(s.done, {{a: s.a, z: s.z, f: s.f}}) ELSE s.done END AS cs FROM c)"""


@query(f"""{_LINES} SELECT u.doc_id, CAST(ix AS INTEGER) AS chunk_ix, p.a AS start, p.z AS stop, coalesce(array_to_string(list_transform(list_sort(list_transform(list_filter(hs, lambda x: x.i < p.f AND len(list_filter(hs, lambda y: y.i > x.i AND y.i < p.f AND y.level <= x.level)) = 0), lambda x: {{l: x.level, t: x.title}})), lambda x: x.t), '|'), '') AS path, sha256(decode(encode(d.text)[p.a + 1:p.z])) AS digest
 FROM (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS ix, unnest(cs) AS p FROM o) u JOIN documents d USING (doc_id) LEFT JOIN h USING (doc_id)""")
def chunk_documents(spark, root):
    c = prepare.chunk_documents(table(spark, root, "documents"))
    return c.select("doc_id", "chunk_ix", "span.start", "span.stop", bar("heading_path").alias("path"), F.sha2("text", 256).alias("digest"))


@query(f"SELECT c.doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE decode(encode(d.text)[c.span.start + 1:c.span.stop]) = c.text) AS n_exact FROM {_CH} c JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL GROUP BY c.doc_id")
def chunk_slices(spark, root):
    c = _chunks(spark, root).select("doc_id", "span", F.col("text").alias("own"))
    d = table(spark, root, "documents").where("text is not null").select("doc_id", "text")
    same = text.byte_slice("text", F.col("span.start"), F.col("span.stop")) == F.col("own")
    return c.join(d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.coalesce(same, F.lit(False))).alias("n_exact"))


@query(f"SELECT chunk_id, {sql.content_id('doc_id', 'span.start', 'span.stop')} AS own_id FROM {_CH}")
def chunk_ids(spark, root):
    return _chunks(spark, root).select("chunk_id", prepare.chunk_id("doc_id", F.col("span.start"), F.col("span.stop")).alias("own_id"))


# text ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_ix, unnest(s) AS sentence FROM (SELECT doc_id, {sql.sentences('text')} AS s FROM documents WHERE text IS NOT NULL)")
def sentences(spark, root):
    return table(spark, root, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("sent_ix", "sentence"))


@query(f"WITH text_rows AS (SELECT doc_id AS k, text AS t FROM documents), {sql.SPANS} SELECT k AS doc_id, sent_ix, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans")
def sentence_spans(spark, root):
    return windows.sentence_spans(table(spark, root, "documents").where("text is not null"), "doc_id").select("doc_id", "sent_ix", "start", "stop")


@query(f"SELECT claim_id, array_to_string({sql.content_words('text')}, '|') AS words FROM claims")
def content_words(spark, root):
    return table(spark, root, "claims").select("claim_id", bar(text.content_words("text")).alias("words"))


@query(f"SELECT doc_id, array_to_string({sql.numbers('text')}, '|') AS numbers FROM documents WHERE text IS NOT NULL")
def numbers_in_text(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", bar(text.numbers("text")).alias("numbers"))


_QUOTES = rf"""list_filter(list_transform(list_filter(regexp_extract_all(text, '"[^"]*("|\z)|“[^”]*(”|\z)'), lambda q: length(q) > 1 AND ((q[1] = '"' AND q[-1] = '"') OR (q[1] = '“' AND q[-1] = '”'))), lambda q: substr(q, 2, length(q) - 2)), lambda q: len({sql.words('q')}) >= 3)"""


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS quote_ix, unnest(s) AS quoted FROM (SELECT doc_id, {_QUOTES} AS s FROM documents WHERE text IS NOT NULL)")
def quotations(spark, root):
    return table(spark, root, "documents").select("doc_id", F.posexplode(text.quotations("text")).alias("quote_ix", "quoted"))


@query("""SELECT doc_id, octet_length(encode(p)) AS at FROM (SELECT doc_id, text, regexp_extract(text, '^(?:[^"“”]|"[^"]*"|“[^”]*”)*', 0) AS p FROM documents) WHERE length(p) < length(text)""")
def stray_marks(spark, root):
    """The byte place of the first mark without a partner."""
    return table(spark, root, "documents").select("doc_id", text.stray_mark_place("text").alias("at")).where("at is not null")


@query(f"SELECT claim_id, {sql.content_id(sql.normalise('text'))} AS claim_key FROM claims")
def claim_keys(spark, root):
    return table(spark, root, "claims").select("claim_id", claims.claim_key("text").alias("claim_key"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS echo FROM documents")
def echoes(spark, root):
    return table(spark, root, "documents").select("doc_id", text.echo("text").alias("echo"))


_NAMED = f"list_filter(list_transform(list_concat([d.title], coalesce(c.heading_path, [])), lambda n: {sql.trim('n')}), lambda n: n IS NOT NULL AND n <> '')"


@query(f"SELECT chunk_id, CASE WHEN len(e) > 0 THEN array_to_string(e, ' ') || ' ' ELSE '' END AS prefix FROM (SELECT c.chunk_id, list_transform({_NAMED}, lambda n: CASE WHEN regexp_matches(n, '[.!?]$') THEN n ELSE n || '.' END) AS e FROM {_CH} c LEFT JOIN documents d USING (doc_id))")
def names_prefix(spark, root):
    d = table(spark, root, "documents").select("doc_id", "title")
    return _chunks(spark, root).join(d, "doc_id", "left").select("chunk_id", text.names_prefix("title", "heading_path").alias("prefix"))


@query(f"SELECT script_id, CAST(sum(len({sql.words('text')})) AS BIGINT) AS words, CAST(sum(len({sql.words('text')})) AS BIGINT) * 60.0 / 150 AS secs FROM {_TU} WHERE text IS NOT NULL GROUP BY script_id")
def estimate_secs(spark, root):
    return _turns(spark, root).where("text is not null").groupBy("script_id").agg(F.sum(text.word_count("text")).alias("words")).withColumn("secs", F.col("words") * 60.0 / DEFAULT.words_per_minute)


@query("""SELECT turn_id, replace(replace(replace(text, '"', ''), '“', ''), '”', '') AS bare FROM script_turns GROUP BY ALL""")
def stripped_marks(spark, root):
    return _turns(spark, root).select("turn_id", text.strip_marks("text").alias("bare"))


@query(f"SELECT turn_id, array_to_string({sql.spoken_tokens('text')}, ' ') AS tokens FROM {_TU} WHERE text IS NOT NULL")
def speech_tokens(spark, root):
    return _turns(spark, root).where("text is not null").select("turn_id", F.array_join(speech.spoken_tokens("text"), " ").alias("tokens"))


@query()
def spoken_words(spark, root):
    return _turns(spark, root).where("text is not null").select("turn_id", F.array_join(speech.spoken_words("text"), " ").alias("words"))


_CW = f"WITH text_rows AS (SELECT chunk_id AS k, text AS t FROM {_CH}), {sql.SPANS}, runs AS (SELECT k, sent_ix AS first, 1 AS n_sents, start, stop FROM spans UNION ALL SELECT * FROM (SELECT k, sent_ix, 2, start, lead(stop) OVER (PARTITION BY k ORDER BY sent_ix) AS stop FROM spans) WHERE stop IS NOT NULL)"
_PREMISE = "decode(encode(t)[CAST(start AS BIGINT) + 1:CAST(stop AS BIGINT)])"
#: All premises: short runs as they are, and the slices of single sentences that are too long (their words joined by spaces).
_ALL = f"""{_CW}, cut AS (SELECT k, first, n_sents, premise, {sql.words('premise')} AS w FROM (SELECT k, first, n_sents, {_PREMISE} AS premise FROM runs JOIN text_rows USING (k))), long_ AS (SELECT k, first, w, list_distinct(list_append(range(0, len(w) - 120, 60), len(w) - 120)) AS ats FROM cut WHERE len(w) > 120 AND n_sents = 1),
 premises AS (SELECT k AS chunk_id, first, n_sents, 0 AS slice, premise FROM cut WHERE len(w) <= 120 UNION ALL SELECT k, first, 1, CAST(s // 60 + CASE WHEN s % 60 > 0 THEN 1 ELSE 0 END AS INTEGER), array_to_string(w[s + 1:s + 120], ' ') FROM (SELECT k, first, w, unnest(ats) AS s FROM long_))"""


@query(f"{_CW}, cut AS (SELECT k, first, n_sents, start, stop, {_PREMISE} AS premise FROM runs JOIN text_rows USING (k)) SELECT k AS chunk_id, first, n_sents, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, sha256(premise) AS digest FROM cut WHERE len({sql.words('premise')}) <= 120")
def sentence_windows(spark, root):
    w = windows.windows(_chunks(spark, root)).where("whole")
    return w.select("chunk_id", "first", "n_sents", "start", "stop", F.sha2("premise", 256).alias("digest"))


@query(f"{_ALL} SELECT chunk_id, first, slice, premise FROM premises JOIN long_ l ON l.k = chunk_id AND l.first = premises.first WHERE n_sents = 1".replace("SELECT chunk_id, first", "SELECT chunk_id, premises.first"))
def long_sentence_slices(spark, root):
    """Their words joined by single spaces."""
    return windows.windows(_chunks(spark, root)).where("not whole").select("chunk_id", "first", "slice", F.regexp_replace("premise", f"{text.WS}+", " ").alias("premise"))


# claims and the ledger -----------------------------------------------------------------------------------------------


def _statements(spark, root):
    d = table(spark, root, "documents").select("doc_id", text.fold_group("source_ref.independence_group").alias("grp"), F.posexplode(text.sentences("text")).alias("draft_ix", "claim_text"))
    return d.withColumn("claim_text", text.trim_ws(text.strip_marks("claim_text"))).where("claim_text <> ''")


_BARE = sql.trim("""replace(replace(replace(s, '"', ''), '“', ''), '”', '')""")
_STATED = f"(SELECT * FROM (SELECT doc_id, i, g, {_BARE} AS claim_text FROM (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s, {sql.fold('source_ref.independence_group')} AS g FROM (SELECT doc_id, source_ref, {sql.sentences('text')} AS ss FROM documents WHERE text IS NOT NULL))) WHERE claim_text <> '')"


@query(f"SELECT claim_id, count(DISTINCT g) AS n_groups, count(*) AS n_statements FROM (SELECT {sql.content_id(sql.normalise('claim_text'))} AS claim_id, g FROM {_STATED}) GROUP BY claim_id HAVING n_groups > 1")
def corroborated_claims(spark, root):
    return claims.merge_counts(_statements(spark, root), "grp").where("n_groups > 1").select("claim_id", "n_groups", "n_statements")


@query(f"SELECT {sql.content_id(sql.normalise('claim_text'))} AS claim_id, arg_min(claim_text, (doc_id, i)) AS text, count(*) AS n FROM {_STATED} GROUP BY 1")
def claim_merge(spark, root):
    keyed = claims.with_key(_statements(spark, root))
    return keyed.groupBy("claim_id").agg(F.min_by("claim_text", F.struct("doc_id", "draft_ix")).alias("text"), F.count("*").alias("n"))


@query(f"SELECT claim_id, status, CASE WHEN status = 'corroborated' THEN array_to_string(s_, '|') END AS groups, CASE WHEN status = 'single_source' THEN s_[1] END AS grp, CASE WHEN status = 'contested' THEN array_to_string(s_, '|') END AS supporting, CASE WHEN status = 'contested' THEN array_to_string(c_, '|') END AS contradicting FROM {sql.LEDGER}")
def ledger_status(spark, root):
    out = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence"))
    return out.select("claim_id", "status", bar("groups").alias("groups"), "grp", bar("supporting").alias("supporting"), bar("contradicting").alias("contradicting"))


@query(f"SELECT status, count(*) AS n FROM {sql.LEDGER} GROUP BY status")
def ledger_summary(spark, root):
    return ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT claim_id, array_to_string(list_sort(list_distinct(list_transform(evidence, lambda e: e.chunk || ':' || coalesce(e.independence_group, '') || ':' || e.stance))), '|') AS evidence FROM claims")
def evidence_sets(spark, root):
    one = F.transform("evidence", lambda e: F.concat(e["chunk"], F.lit(":"), F.coalesce(e["independence_group"], F.lit("")), F.lit(":"), e["stance"]))
    return table(spark, root, "claims").select("claim_id", bar(F.array_sort(F.array_distinct(one))).alias("evidence"))


@query(f"SELECT claim_id, arg_min(doc_id, (doc_id, chunk_ix)) AS doc_id, arg_min(chunk_ix, (doc_id, chunk_ix)) AS chunk_ix FROM (SELECT claim_id, unnest(CASE WHEN len(evidence) > 0 THEN list_transform(evidence, lambda e: e.chunk) ELSE [NULL] END) AS chunk_id FROM claims) LEFT JOIN {_CH} USING (chunk_id) GROUP BY claim_id")
def first_appearance(spark, root):
    return ledger.first_appearance(table(spark, root, "claims"), _chunks(spark, root), "doc_id", "chunk_ix")


@query(f"SELECT l.claim_id, generate_subscripts(l.evidence, 1) - 1 AS ev_ix, unnest(l.evidence).stance AS stance, unnest(l.evidence).chunk AS chunk FROM {sql.LEDGER} l WHERE status = 'contested'")
def contested_evidence(spark, root):
    c = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status = 'contested'")
    return c.select("claim_id", F.posexplode("evidence").alias("ev_ix", "e")).select("claim_id", "ev_ix", F.col("e.stance").alias("stance"), F.col("e.chunk").alias("chunk"))


@query(f"SELECT e.claim_id, e.ev_ix, e.stance, d.title, c.text AS passage FROM (SELECT claim_id, generate_subscripts(evidence, 1) - 1 AS ev_ix, unnest(evidence).stance AS stance, unnest(evidence).chunk AS chunk_id FROM {sql.LEDGER} WHERE status = 'contested') e LEFT JOIN {_CH} c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id")
def contested_passages(spark, root):
    contested = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status = 'contested'")
    return adjudicate.passages(contested, _chunks(spark, root), table(spark, root, "documents"))


_FIRST = "list_filter(evidence, lambda e: e.stance = '{}')[1].chunk"


@query(f"SELECT claim_id, 'unresolved' AS favours, array_to_string(list_filter([{_FIRST.format('supports')}, {_FIRST.format('contradicts')}], lambda x: x IS NOT NULL), '|') AS cites FROM {sql.LEDGER} WHERE status = 'contested'")
def fallback_verdicts(spark, root):
    contested = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status = 'contested'")
    return adjudicate.fallback(contested).select("claim_id", "favours", bar("cites").alias("cites"))


_SIDE = "CASE WHEN claim_id[1] < '5' THEN 'supporting' WHEN claim_id[1] < 'a' THEN 'contradicting' ELSE 'unresolved' END"


def _favoured(contested):
    """Verdicts whose side follows from the claim's id."""
    first = F.substring("claim_id", 1, 1)
    return adjudicate.fallback(contested).withColumn("favours", F.when(first < "5", "supporting").when(first < "a", "contradicting").otherwise("unresolved"))


@query(f"SELECT {_SIDE} AS favours, count(*) AS n FROM {sql.LEDGER} WHERE status = 'contested' GROUP BY 1")
def verdict_tallies(spark, root):
    contested = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status = 'contested'")
    return adjudicate.tallies(_favoured(contested))


@query(f"SELECT claim_id, 'corroborated' AS stored FROM {sql.LEDGER} WHERE claim_id[1] = 'a' AND status <> 'corroborated'")
def ledger_integrity(spark, root):
    """The ledger with the status of some claims overwritten: those where that is not what their evidence gives."""
    stored = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence"))
    forged = stored.withColumn("status", F.when(F.col("claim_id").startswith("a"), "corroborated").otherwise(F.col("status")))
    return ledger.tampered(forged).select("claim_id", "stored")


_EV = f"(SELECT DISTINCT claim_id, text AS claim_text, unnest(list_transform(evidence, lambda e: e.chunk)) AS chunk_id FROM claims)"
_GROUND = f"""SELECT claim_id, chunk_id, coalesce(len(list_filter(list_filter(w, lambda n_: regexp_matches(n_, '[0-9]')), lambda n_: NOT list_contains(p, n_) AND NOT list_contains(nm, n_))) = 0 AND len(said) > 0 AND len(list_intersect(said, p)) >= 0.6 * len(said), false) AS grounded
 FROM (SELECT *, list_filter(w, lambda n_: NOT list_contains(nm, n_)) AS said FROM (SELECT e.claim_id, e.chunk_id, {sql.content_words('e.claim_text')} AS w, {sql.content_words('c.text')} AS p, {sql.content_words("concat_ws(' ', d.title, array_to_string(c.heading_path, ' '))")} AS nm
 FROM {_EV} e JOIN {_CH} c USING (chunk_id) LEFT JOIN documents d ON d.doc_id = c.doc_id))"""


def _evidence(spark, root):
    return table(spark, root, "claims").select("claim_id", F.col("text"), F.explode("evidence.chunk").alias("chunk_id")).distinct()


@query(_GROUND)
def lexical_grounding(spark, root):
    c = _chunks(spark, root).select("chunk_id", "doc_id", F.col("text").alias("passage"), "heading_path")
    d = table(spark, root, "documents").select("doc_id", "title")
    j = _evidence(spark, root).join(c, "chunk_id").join(d, "doc_id", "left").withColumn("names", F.concat_ws(" ", "title", F.array_join("heading_path", " ")))
    return j.select("claim_id", "chunk_id", claims.is_grounded("text", "passage", "names").alias("grounded"))


_JUDGED = f"""{_ALL},
 ev AS {_EV}, pw AS (SELECT *, {sql.content_words('premise')} AS p_ FROM premises WHERE chunk_id IN (SELECT chunk_id FROM ev)), hw AS (SELECT *, {sql.content_words('claim_text')} AS h_ FROM ev),
 pairs AS (SELECT claim_id, chunk_id, first, n_sents, slice, premise, p_, h_, {sql.slot_cosine('ps', 'hs')} AS cos FROM (SELECT *, {sql.slots('p_')} AS ps, {sql.slots('h_')} AS hs FROM hw JOIN pw USING (chunk_id))),
 top AS (SELECT *, row_number() OVER (PARTITION BY claim_id, chunk_id ORDER BY cos DESC, first, n_sents, slice) AS rank FROM pairs QUALIFY rank <= 4),
 best AS (SELECT claim_id, chunk_id, {sql.per_mille('entailment')} AS entail_pm, rank FROM (SELECT claim_id, chunk_id, rank, {sql.nli('p', 'h')} FROM top))"""


def _judged(spark, root):
    c = _chunks(spark, root)
    w = windows.windows(c.join(_evidence(spark, root).select("chunk_id").distinct(), "chunk_id", "left_semi"))
    return ground.judge(_evidence(spark, root), w)


@query(f"{_JUDGED} SELECT ev.claim_id, ev.chunk_id, max(entail_pm) AS entail_pm, CASE WHEN max(entail_pm) >= 800 THEN 'keep' ELSE 'reject' END AS outcome FROM ev LEFT JOIN best USING (claim_id, chunk_id) GROUP BY ALL")
def ground_evidence(spark, root):
    j = _judged(spark, root)
    return j.select("claim_id", "chunk_id", "entail_pm", F.when(F.col("entail_pm") >= DEFAULT.ground_pm, "keep").otherwise("reject").alias("outcome"))


@query(f"{_JUDGED} SELECT ev.claim_id, max(entail_pm) AS best_pm FROM ev LEFT JOIN best USING (claim_id, chunk_id) GROUP BY ev.claim_id HAVING coalesce(max(entail_pm), 0) < 800")
def dropped_claims(spark, root):
    return ground.dropped_claims(_judged(spark, root))


# stances -------------------------------------------------------------------------------------------------------------


@query(f"SELECT item_id, {sql.per_mille('entailment')} AS entail_pm, {sql.per_mille('contradiction')} AS contra_pm FROM (SELECT item_id, {sql.nli('p', 'h')} FROM (SELECT item_id, {sql.content_words('premise')} AS p_, {sql.content_words('claim')} AS h_ FROM stance_pairs))")
def nli_scores(spark, root):
    s = stances.score(table(spark, root, "stance_pairs").select("item_id", "claim", "premise"))
    return s.select("item_id", "entail_pm", "contra_pm")


_PAIRS = f"""scored AS (SELECT item_id, label, claim, premise, p_, h_, {sql.per_mille(sql.slot_cosine('ps', 'hs'))} AS sim_pm, {sql.nli('p', 'h')} FROM (SELECT *, {sql.slots('p_')} AS ps, {sql.slots('h_')} AS hs FROM (SELECT *, {sql.content_words('premise')} AS p_, {sql.content_words('claim')} AS h_ FROM stance_pairs))),
 hyps AS (SELECT item_id, h_ AS rp_, unnest(CASE WHEN len(nu) > 0 AND len(nu) < len(al) THEN list_append(nu, premise) ELSE nu END) AS hyp FROM (SELECT item_id, h_, premise, al, list_filter(al, lambda s: len({sql.numbers('s')}) > 0) AS nu FROM (SELECT item_id, h_, premise, {sql.sentences('premise')} AS al FROM scored WHERE entailment < 0.7995 AND contradiction >= 0.9495 AND sim_pm >= 600 AND len(list_filter(h_, lambda n_: regexp_matches(n_, '[0-9]'))) > 0))),
 rev AS (SELECT item_id, max({sql.per_mille('contradiction')}) AS reverse_pm FROM (SELECT item_id, {sql.nli('p', 'h', 'x')} FROM (SELECT item_id, rp_ AS xp_, {sql.content_words('hyp')} AS xh_ FROM hyps)) GROUP BY item_id),
 decided AS (SELECT s.item_id, label, sim_pm, reverse_pm, CASE WHEN {sql.per_mille('entailment')} >= 800 THEN 'supports' WHEN {sql.per_mille('contradiction')} >= 950 AND sim_pm >= 600 AND (len(list_filter(h_, lambda n_: regexp_matches(n_, '[0-9]'))) = 0 OR len(list_filter(p_, lambda n_: regexp_matches(n_, '[0-9]'))) = 0 OR coalesce(reverse_pm, 0) >= 950) THEN 'contradicts' END AS stance FROM scored s LEFT JOIN rev USING (item_id))"""


@query(f"WITH {_PAIRS} SELECT item_id, sim_pm, reverse_pm, stance FROM decided")
def stance_decisions(spark, root):
    return stances.score(table(spark, root, "stance_pairs").select("item_id", "claim", "premise")).select("item_id", "sim_pm", "reverse_pm", "stance")


_RATE = "CASE WHEN {0} + {1} > 0 THEN CAST(round(1000 * {0} / ({0} + {1})) AS INTEGER) END"


@query(f"WITH {_PAIRS}, c AS (SELECT k.stance, count(*) FILTER (WHERE d.stance IS NOT DISTINCT FROM k.stance AND label = k.stance) AS tp, count(*) FILTER (WHERE d.stance IS NOT DISTINCT FROM k.stance AND label <> k.stance) AS fp, count(*) FILTER (WHERE d.stance IS DISTINCT FROM k.stance AND label = k.stance) AS fn FROM (VALUES ('supports'), ('contradicts')) k(stance) CROSS JOIN decided d GROUP BY 1) SELECT stance, tp, fp, fn, {_RATE.format('tp', 'fp')} AS precision_pm, {_RATE.format('tp', 'fn')} AS recall_pm FROM c")
def precision_recall(spark, root):
    return stances.report(stances.score(table(spark, root, "stance_pairs").select("label", "claim", "premise")))


_TOPW = f"""{_ALL}, ws AS (SELECT chunk_id, first, n_sents, slice, {sql.slots(sql.content_words('premise'))} AS ps FROM premises),
 wn AS (SELECT *, row_number() OVER (ORDER BY chunk_id, first, n_sents, slice) AS w FROM ws WHERE len(ps) > 0), wl AS (SELECT w, unnest(ps) AS s FROM wn), wc AS (SELECT w, s, count(*) AS n FROM wl GROUP BY ALL), w2 AS (SELECT w, sum(n * n) AS q FROM wc GROUP BY w),
 qs AS (SELECT item_id, unnest({sql.slots(sql.content_words('claim'))}) AS s FROM stance_pairs), qc AS (SELECT item_id, s, count(*) AS n FROM qs GROUP BY ALL), q2 AS (SELECT item_id, sum(n * n) AS q FROM qc GROUP BY item_id),
 dots AS (SELECT item_id, w, sum(qc.n * wc.n) AS dot FROM qc JOIN wc USING (s) GROUP BY ALL), sims AS (SELECT item_id, w, {sql.per_mille('dot / sqrt(CAST(q2.q * w2.q AS DOUBLE))')} AS sim_pm FROM dots JOIN q2 USING (item_id) JOIN w2 USING (w))
 SELECT item_id, rank, sim_pm FROM (SELECT item_id, sim_pm, row_number() OVER (PARTITION BY item_id ORDER BY sim_pm DESC, w) AS rank FROM sims WHERE sim_pm >= 300) WHERE rank <= 4"""


@query(_TOPW)
def topk_windows(spark, root):
    w = windows.windows(_chunks(spark, root))
    c = w.select(F.xxhash64("chunk_id", "first", "n_sents", "slice").alias("id"), F.xxhash64("chunk_id", "first", "n_sents", "slice").alias("ord"), vectors.slots_of("premise").alias("vec"), F.lit(None).cast("string").alias("grp"))
    q = table(spark, root, "stance_pairs").select(F.col("item_id").alias("id"), vectors.slots_of("claim").alias("vec"), F.array().cast("array<string>").alias("grp"))
    return vectors.top_k(q, c, DEFAULT.retrieve_k, DEFAULT.retrieve_floor_pm).select(F.col("qid").alias("item_id"), "rank", "sim_pm")


@query("""SELECT qid, rank, sim_pm FROM (SELECT a.vec_id AS qid, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) DESC) AS rank,
 CAST(round(greatest(0.0, least(1.0, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))) * 1000) AS INTEGER) AS sim_pm FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 8""")
def topk_vectors(spark, root):
    e = table(spark, root, "embeddings").where(vectors.usable("embedding")).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"))
    out = vectors.top_k(e.select("id", "vec", F.array().cast("array<string>").alias("grp")), e.withColumn("grp", F.lit(None).cast("string")), DEFAULT.merge_partners, slots=None, on_pm=False)
    return out.select("qid", "rank", "sim_pm")


def _equivalent(spark, root):
    return cluster.equivalent(cluster.nominated(table(spark, root, "claims").select("claim_id", "text")))


_EQUIVALENT = f"""WITH RECURSIVE c AS (SELECT claim_id, text, {sql.content_words('text')} AS w FROM claims), sl AS (SELECT claim_id, unnest({sql.slots('w')}) AS s FROM c), sc AS (SELECT claim_id, s, count(*) AS n FROM sl GROUP BY ALL), q2 AS (SELECT claim_id, sum(n * n) AS q FROM sc GROUP BY ALL),
 dots AS (SELECT x.claim_id AS a, y.claim_id AS b, sum(x.n * y.n) AS dot FROM sc x JOIN sc y USING (s) WHERE x.claim_id <> y.claim_id GROUP BY ALL), sims AS (SELECT a, b, {sql.per_mille('dot / sqrt(CAST(p.q * r.q AS DOUBLE))')} AS sim_pm FROM dots JOIN q2 p ON p.claim_id = a JOIN q2 r ON r.claim_id = b),
 top AS (SELECT a, b FROM sims WHERE sim_pm >= 800 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim_pm DESC, b) <= 8), pairs AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM top), both_ AS (SELECT a, b, x.w AS xw, y.w AS yw FROM pairs JOIN c x ON x.claim_id = a JOIN c y ON y.claim_id = b WHERE list_filter(x.w, lambda n_: regexp_matches(n_, '[0-9]')) = list_filter(y.w, lambda n_: regexp_matches(n_, '[0-9]'))),
 f AS (SELECT a, b, {sql.per_mille('entailment')} AS f FROM (SELECT a, b, {sql.nli('p', 'h')} FROM (SELECT a, b, xw AS p_, yw AS h_ FROM both_))), g AS (SELECT a, b, {sql.per_mille('entailment')} AS g FROM (SELECT a, b, {sql.nli('p', 'h')} FROM (SELECT a, b, yw AS p_, xw AS h_ FROM both_))),
 eq AS (SELECT a, b, least(f, g) AS mutual_pm FROM f JOIN g USING (a, b) WHERE least(f, g) >= 800)"""


@query(f"{_EQUIVALENT} SELECT * FROM eq")
def equivalent_claims(spark, root):
    return _equivalent(spark, root)


#: Claims in order; each that is free leads, and takes in those behind it that have an edge to all it has.
@query(f"""{_EQUIVALENT}, nb AS (SELECT n, list(m ORDER BY m) AS near FROM (SELECT a AS n, b AS m FROM eq UNION ALL SELECT b, a FROM eq) GROUP BY n), all_ AS (SELECT map(list(n), list(near)) AS m FROM nb), od AS (SELECT n, near, row_number() OVER (ORDER BY n) AS i FROM nb),
 st(i, taken, led) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL SELECT i, CASE WHEN free THEN list_concat(taken, grp) ELSE taken END, CASE WHEN free THEN list_concat(led, list_transform(grp, lambda x: n)) ELSE led END FROM (SELECT od.i, od.n, st.taken, st.led, NOT list_contains(st.taken, od.n) AS free,
  list_reduce(list_transform(list_filter(od.near, lambda x: x > od.n AND NOT list_contains(st.taken, x)), lambda x: [x]), lambda acc, x: CASE WHEN list_has_all(all_.m[x[1]], acc) THEN list_concat(acc, x) ELSE acc END, [od.n]) AS grp FROM st JOIN od ON od.i = st.i + 1 CROSS JOIN all_))
 SELECT unnest(taken) AS claim_id, unnest(led) AS lead FROM st WHERE i = (SELECT max(i) FROM st)""")
def claim_clusters(spark, root):
    return cluster.clusters(_equivalent(spark, root))


# scripts -------------------------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT turn_id, text, quotes FROM {_TU}), q AS (SELECT turn_id, text, generate_subscripts(quotes, 1) - 1 AS check_ix, unnest(quotes) AS q FROM t),
 j AS (SELECT turn_id, check_ix, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN NOT coalesce(q.q.span.stop <= octet_length(encode(d.text)) AND hex(encode(d.text)[q.q.span.start + 1:q.q.span.stop]) = hex(encode(q.q.text)), false) THEN 'differs' WHEN NOT coalesce(contains(q.text, q.q.text), false) THEN 'unspoken' END AS problem FROM q LEFT JOIN documents d ON d.doc_id = q.q.document)
 SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem""")
def quote_problems(spark, root):
    f = analyse.quote_findings(_turns(spark, root), table(spark, root, "documents").select("doc_id", "text")).where("kind = 'quote'")
    m = F.col("message")
    kind = F.when(m.startswith("quote cites unknown"), "unknown").when(m.startswith("quote does not match"), "differs").otherwise("unspoken")
    return f.groupBy(kind.alias("problem")).agg(F.count("*").alias("n"))


@query(f"SELECT turn_id, q AS quoted FROM (SELECT turn_id, quotes, unnest({_QUOTES}) AS q FROM {_TU} WHERE text IS NOT NULL) WHERE NOT coalesce(list_bool_or(list_transform(quotes, lambda x: contains(x.text, q))), false)")
def uncovered_quotations(spark, root):
    f = analyse.quote_findings(_turns(spark, root), table(spark, root, "documents").select("doc_id", "text")).where("kind = 'quotation'")
    return f.select("turn_id", F.regexp_replace("message", r"\Aturn quotes words no quote covers: ", "").alias("quoted"))


@query(f"SELECT turn_id, regexp_replace(regexp_replace(f, '^{sql.NOT_ALNUM}', ''), '{sql.NOT_ALNUM}$', '') AS figure FROM (SELECT turn_id, list_filter({sql.words('bare')}, lambda w: regexp_matches(w, '[0-9]'))[1] AS f FROM (SELECT turn_id, list_reduce(list_concat([text], list_transform(coalesce(quotes, []), lambda q: q.text)), lambda a, x: CASE WHEN coalesce(x, '') = '' THEN a ELSE replace(a, x, ' ') END) AS bare FROM {_TU} WHERE coalesce(len(citations), 0) = 0 AND text IS NOT NULL)) WHERE f IS NOT NULL")
def uncited_figures(spark, root):
    return analyse.uncited_figures(_turns(spark, root)).select("turn_id", "figure")


@query(f"SELECT turn_id, c AS claim_id FROM (SELECT DISTINCT turn_id, unnest(citations) AS c FROM {_TU}) WHERE c NOT IN (SELECT claim_id FROM {sql.LEDGER} WHERE status <> 'single_source')")
def unknown_citations(spark, root):
    """Against a ledger from which the claims of a single source were taken."""
    c = _turns(spark, root).select("turn_id", F.explode("citations").alias("claim_id")).distinct()
    kept = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status <> 'single_source'")
    return c.join(kept.select("claim_id"), "claim_id", "left_anti").select("turn_id", "claim_id")


@query(f"SELECT claim_id FROM {sql.LEDGER} WHERE status = 'contested' AND claim_id NOT IN (SELECT unnest(citations) FROM script_turns)")
def judged_but_uncited(spark, root):
    contested = ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")).where("status = 'contested'").select("claim_id")
    return contested.join(_turns(spark, root).select(F.explode("citations").alias("claim_id")), "claim_id", "left_anti")


@query(f"SELECT claim_id, count(*) AS times FROM (SELECT unnest(citations) AS claim_id FROM {_TU}) GROUP BY claim_id")
def citation_counts(spark, root):
    return _turns(spark, root).select(F.explode("citations").alias("claim_id")).groupBy("claim_id").agg(F.count("*").alias("times"))


@query(f"""WITH t AS (SELECT * FROM {_TU}), b AS (SELECT script_id, CAST(sum(len({sql.words("coalesce(text, '')")})) AS BIGINT) AS words, count(*) AS turns, CAST(sum(coalesce(len(quotes), 0)) AS BIGINT) AS quotes, CAST(sum(coalesce(len(citations), 0)) AS BIGINT) AS citations FROM t GROUP BY script_id), l AS (SELECT claim_id, status FROM {sql.LEDGER}),
 c AS (SELECT script_id, claim_id, count(*) AS times FROM (SELECT script_id, unnest(citations) AS claim_id FROM t) GROUP BY ALL), j AS (SELECT script_id, count(*) FILTER (WHERE status <> 'unsupported') AS distinct_cited, count(*) FILTER (WHERE status = 'unsupported') AS cited_unsupported, CAST(coalesce(sum(times) FILTER (WHERE status IS NULL), 0) AS BIGINT) AS unknown_citations, count(*) FILTER (WHERE status = 'contested') AS judged_cited FROM c LEFT JOIN l USING (claim_id) GROUP BY script_id), u AS (SELECT count(*) AS usable_claims FROM l WHERE status <> 'unsupported')
 SELECT script_id, words, words / 1500.0 AS word_ratio, turns, quotes, citations, coalesce(distinct_cited, 0) AS distinct_cited, coalesce(cited_unsupported, 0) AS cited_unsupported, usable_claims, coalesce(distinct_cited, 0) / usable_claims AS coverage, coalesce(judged_cited, 0) AS judged_cited, coalesce(unknown_citations, 0) AS unknown_citations FROM b LEFT JOIN j USING (script_id) CROSS JOIN u""")
def script_metrics(spark, root):
    return analyse.script_metrics(_turns(spark, root), ledger.classify(table(spark, root, "claims").select("claim_id", "evidence")))


@query(f"""WITH o AS (SELECT DISTINCT s.backend AS k, c.claim_id FROM (SELECT script_id, unnest(citations) AS claim_id FROM {_TU}) c JOIN scripts s USING (script_id) WHERE s.backend IS NOT NULL), n AS (SELECT k, count(*) AS n FROM o GROUP BY k), sh AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM o x JOIN o y USING (claim_id) WHERE x.k < y.k GROUP BY ALL)
 SELECT x.k AS a, y.k AS b, coalesce(shared, 0) AS shared, x.n - coalesce(shared, 0) AS only_a, y.n - coalesce(shared, 0) AS only_b, coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) AS jaccard FROM n x JOIN n y ON x.k < y.k LEFT JOIN sh ON sh.a = x.k AND sh.b = y.k""")
def citation_overlap(spark, root):
    c = _turns(spark, root).select("script_id", F.explode("citations").alias("claim_id")).join(table(spark, root, "scripts").select("script_id", "backend"), "script_id").where("backend is not null")
    return analyse.citation_overlap(c, "backend")


_MARKED = f"(SELECT script_id, turn, CASE WHEN pace = 'interrupt' THEN 'banter' WHEN callback_to IS NOT NULL THEN 'recap' END AS mark FROM {_TU})"


def _marked(spark, root):
    return _turns(spark, root).select("script_id", "turn", F.when(F.col("pace") == "interrupt", "banter").when(F.col("callback_to").isNotNull(), "recap").alias("mark"))


@query(f"SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY turn) - 1 AS beat, coalesce(mark, 'narration') AS kind, turn AS start, coalesce(lead(turn) OVER (PARTITION BY script_id ORDER BY turn), last_ + 1) AS stop FROM (SELECT *, count(mark) OVER (PARTITION BY script_id) AS n_, min(turn) OVER (PARTITION BY script_id) AS first_, max(turn) OVER (PARTITION BY script_id) AS last_ FROM {_MARKED}) WHERE n_ > 0 AND (mark IS NOT NULL OR turn = first_)")
def beats_from_marks(spark, root):
    return script.beats(_marked(spark, root))


@query(f"WITH m AS (SELECT script_id FROM {_MARKED} GROUP BY script_id HAVING count(mark) = 0) SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY turn) - 1 AS beat, turn AS start, turn + 1 AS stop FROM {_TU} WHERE script_id IN (SELECT script_id FROM m)")
def implied_beats(spark, root):
    t = _marked(spark, root)
    stored = script.beats(t)
    return script.implied_beats(t, stored).join(stored.select("script_id").distinct(), "script_id", "left_anti").select("script_id", "beat", "start", "stop")


@query(f"""WITH b AS (SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY turn) - 1 AS beat, turn AS start, coalesce(lead(turn) OVER (PARTITION BY script_id ORDER BY turn), last_ + 1) AS stop FROM (SELECT *, count(mark) OVER (PARTITION BY script_id) AS n_, min(turn) OVER (PARTITION BY script_id) AS first_, max(turn) OVER (PARTITION BY script_id) AS last_ FROM {_MARKED}) WHERE n_ > 0 AND (mark IS NOT NULL OR turn = first_)),
 f AS (SELECT script_id, beat, start + CASE WHEN beat % 5 = 2 THEN 1 ELSE 0 END AS start, stop + CASE WHEN beat % 7 = 3 THEN 1 ELSE 0 END AS stop FROM b), p AS (SELECT *, lag(stop) OVER (PARTITION BY script_id ORDER BY start, stop) AS before FROM f)
 SELECT script_id, beat, CASE WHEN stop <= start THEN 'empty' WHEN before > start THEN 'overlap' ELSE 'gap' END AS problem FROM p WHERE stop <= start OR before <> start OR (before IS NULL AND start > 0)""")
def broken_beats(spark, root):
    """Beats of which some begin or end a turn late."""
    stored = script.beats(_marked(spark, root))
    off = stored.withColumn("start", F.col("start") + F.when(F.col("beat") % 5 == 2, 1).otherwise(0)).withColumn("stop", F.col("stop") + F.when(F.col("beat") % 7 == 3, 1).otherwise(0))
    return script.broken_beats(off)


@query(f"SELECT turn_id, script_id, speaker FROM {_TU} WHERE script_id % 2 = 1 AND speaker IN ('guest', 'caller')")
def undeclared_speakers(spark, root):
    """Against casts that lack the guests of every other script."""
    t = _turns(spark, root)
    cast = t.select("script_id", "speaker").where("not (script_id % 2 = 1 and speaker in ('guest', 'caller'))").distinct()
    return script.undeclared_speakers(t.select("turn_id", "script_id", "speaker"), cast).select("turn_id", "script_id", "speaker")


@query(f"SELECT p.script_id, p.chunk_no, max(x.turn) AS last_turn, lag(max(x.turn)) OVER (PARTITION BY p.script_id ORDER BY p.chunk_no) AS previous FROM planned_chunks p, unnest(p.pieces) u(x) GROUP BY p.script_id, p.chunk_no")
def chunk_context(spark, root):
    c = table(spark, root, "planned_chunks").select("script_id", "chunk_no", F.array_distinct("pieces.turn").alias("turns"))
    out = script.context(c, _turns(spark, root).select("script_id", "turn", "callback_to"))
    return out.join(c, ["script_id", "chunk_no"]).select("script_id", "chunk_no", F.array_max("turns").alias("last_turn"), "previous")


def _to_plan(spark, root):
    t = _turns(spark, root).where("text is not null").select("script_id", "turn", "speaker", "text", F.col("quotes.text").alias("quotes"))
    beat = _pieces(spark, root).groupBy("script_id", "turn").agg(F.min("beat").alias("beat"))
    s = table(spark, root, "scripts").select("script_id", "backend").join(table(spark, root, "backends"), "backend")
    return t.join(beat, ["script_id", "turn"], "left").withColumn("beat", F.coalesce("beat", "turn")).join(s, "script_id").withColumn("max_speakers", F.lit(2))


@query()
def plan_chunks(spark, root):
    return plan.plan_chunks(_to_plan(spark, root))


@query(f"SELECT script_id, count(*) AS n_turns, true AS whole, true AS within FROM {_TU} JOIN scripts USING (script_id) JOIN backends USING (backend) WHERE text IS NOT NULL GROUP BY script_id")
def plans_hold(spark, root):
    """Of each script's plan: whether its pieces give every turn again, in order, and whether each chunk is one piece or within the seconds and voices of its backend."""
    rows = _to_plan(spark, root)
    p = plan.plan_chunks(rows).select("script_id", "chunk_no", F.posexplode("pieces").alias("ix", "p")).select("script_id", "chunk_no", "ix", "p.turn", "p.start", "p.stop")
    j = p.join(rows.select("script_id", "turn", "speaker", "text", "max_chunk_secs", "max_speakers"), ["script_id", "turn"]).withColumn("own", F.expr("substring(text, start + 1, stop - start)"))
    bare = lambda c: F.regexp_replace(c, f"{text.WS}+", "")
    again = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "ix", bare("own").alias("t")))), lambda x: x["t"]), "")
    turns = j.groupBy("script_id", "turn").agg((again == bare(F.first("text"))).alias("ok")).groupBy("script_id").agg(F.count("*").alias("n_turns"), F.bool_and("ok").alias("whole"))
    fits = (F.count("*") == 1) | ((F.sum(text.word_count("own")) * 60.0 / DEFAULT.words_per_minute <= F.max("max_chunk_secs") + 1e-9) & (F.count_distinct("speaker") <= F.max("max_speakers")))
    chunks = j.groupBy("script_id", "chunk_no").agg(fits.alias("ok")).groupBy("script_id").agg(F.bool_and("ok").alias("within"))
    return turns.join(chunks, "script_id").select("script_id", "n_turns", "whole", "within")


@query(f"SELECT l.claim_id, l.status, CASE WHEN l.status = 'contested' THEN 'unresolved' END AS favours FROM {sql.LEDGER} l")
def ledger_view(spark, root):
    own = ledger.classify(table(spark, root, "claims"))
    verdicts = adjudicate.fallback(own.where("status = 'contested'"))
    return script.ledger_view(own, verdicts).select("claim_id", "status", "favours")


@query(f"WITH text_rows AS (SELECT chunk_id AS k, text AS t FROM {_CH}), {sql.SPANS} SELECT k AS chunk_id, sent_ix AS sent_no, CAST(s.start + c.span.start AS BIGINT) AS start, CAST(s.stop + c.span.start AS BIGINT) AS stop FROM spans s JOIN {_CH} c ON c.chunk_id = k")
def numbered_sources(spark, root):
    c = _chunks(spark, root).select(F.col("chunk_id").alias("source_no"), "doc_id", F.col("span.start").alias("start"), "text")
    return references.numbered(c).select(F.col("source_no").alias("chunk_id"), "sent_no", "span.start", "span.stop")


# speech --------------------------------------------------------------------------------------------------------------


@query(f"SELECT turn_id, count(*) AS n_quotes, count(*) FILTER (WHERE contains('|' || h || '|', '|' || q || '|')) AS n_heard FROM (SELECT turn_id, array_to_string({sql.spoken_tokens('text')}, '|') AS h, array_to_string({sql.spoken_tokens('q')}, '|') AS q FROM (SELECT turn_id, text, unnest(quotes).text AS q FROM {_TU} WHERE text IS NOT NULL)) GROUP BY turn_id")
def quotes_heard(spark, root):
    t = _turns(spark, root).where("text is not null").select("turn_id", speech.spoken_tokens("text").alias("heard"), F.explode("quotes.text").alias("q"))
    rows = t.select("turn_id", verify.contains_words(F.col("heard"), speech.spoken_tokens("q")).alias("ok"))
    return rows.groupBy("turn_id").agg(F.count("*").alias("n_quotes"), F.count_if("ok").alias("n_heard"))


#: Words as characters of one byte, by their first place in both texts together; no turn has more than 126 different ones.
_AS_TEXT = "array_to_string(list_transform({0}, lambda w_: chr(list_position(v, w_))), '')"


@query(f"""SELECT turn_id, quote_ix, CAST(CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0 ELSE 1000 END ELSE least(1000, ceil(levenshtein({_AS_TEXT.format('r')}, {_AS_TEXT.format('h')}) * 1000 / len(r))) END AS INTEGER) AS wer_pm FROM (SELECT turn_id, quote_ix, r, h, list_distinct(list_concat(r, h)) AS v FROM
 (SELECT turn_id, quote_ix, {sql.spoken_tokens('q')} AS r, {sql.spoken_tokens('text')} AS h FROM (SELECT turn_id, text, generate_subscripts(quotes, 1) - 1 AS quote_ix, unnest(quotes).text AS q FROM {_TU} WHERE text IS NOT NULL)))""")
def turn_wer(spark, root):
    """Word errors of each turn's quote read as the turn's text."""
    t = _turns(spark, root).where("text is not null").select("turn_id", "text", F.posexplode("quotes.text").alias("quote_ix", "q"))
    return t.select("turn_id", "quote_ix", verify.wer_pm(speech.spoken_tokens("q"), speech.spoken_tokens("text")).alias("wer_pm"))


@query("SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_median(spark, root):
    return ranking.upper_median(table(spark, root, "events"), "event_type", "value")


@query("WITH m AS (SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT user_id, event_id AS take FROM events JOIN m USING (event_type) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 3 = 0), event_id % 7, abs(value - median), event_id) = 1")
def best_take(spark, root):
    e = table(spark, root, "events").where("value is not null")
    m = ranking.upper_median(e, "event_type", "value")
    takes = e.join(m, "event_type").select("user_id", F.col("event_id").alias("take"), (F.col("event_id") % 3 != 0).alias("passed"), (F.col("event_id") % 7).alias("wer_pm"), F.col("value").alias("rate"), "median")
    return ranking.best_take(takes, "user_id").select("user_id", "take")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 4")
def top_events(spark, root):
    return ranking.top_per_key(table(spark, root, "events").select("user_id", "event_id", "value"), "user_id", 4, F.desc_nulls_last("value"), "event_id").select("user_id", "event_id", "rank")


@query(f"SELECT chunk_id, octet_length(encode(text)) AS n_bytes FROM {_CH}")
def latest_chunks(spark, root):
    return _chunks(spark, root).select("chunk_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT s.backend, count(*) AS n_scripts, avg(s.n_turns) AS mean_turns, count(*) FILTER (WHERE s.title IS NULL) AS n_untitled FROM scripts s GROUP BY s.backend")
def script_summary(spark, root):
    return table(spark, root, "scripts").groupBy("backend").agg(F.count("*").alias("n_scripts"), F.avg("n_turns").alias("mean_turns"), F.count_if(F.col("title").isNull()).alias("n_untitled"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) > 12000")
def oversized_texts(spark, root):
    return table(spark, root, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")).where("bytes > 12000")


@query("SELECT item_id FROM items WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0")
def usable_vectors(spark, root):
    return table(spark, root, "items").where(vectors.usable("embedding")).select("item_id")


from loomledger.plans import drafts, studio  # noqa: E402, F401 - they register theirs


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
