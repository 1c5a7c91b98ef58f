"""An episode's run: sources to documents, chunks, claims, ledger, verdicts, script and analysis, every stage cached by what goes in.

Each stage is a lazy plan that Catalyst optimises as a whole; stages end in the cache, where an equal input is a hit.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomledger.config import DEFAULT
from loomledger.functions import text
from loomledger.operators import adjudicate, analyse, claims, cluster, ground, ledger, prepare, references, script, stances, vectors, windows
from loomledger.operators.models import Models, asked
from loomledger.schemas import ARTIFACTS, BASIS
from loomledger.shipping import ship
from loomledger.sources.artifacts import StageCache, write_artifact
from loomledger.sources.documents import local_files, union_sources
from loomledger.sources.providers import Llm, make

_KEYS = {"title", "topic", "target_minutes", "sources", "llm", "embedding", "nli", "analysers", "cast"}


@dataclass(frozen=True)
class Spec:
    title: str
    topic: str
    target_minutes: int
    sources: tuple[dict, ...]
    entailment: bool
    analysers: tuple[str, ...] = ()
    base: str = "."
    #: By part: the kind of its provider and the provider's options.
    providers: tuple[tuple[str, str, tuple], ...] = ()

    def models(self) -> Models:
        made = {part: make(part, kind, **dict(options)) for part, kind, options in self.providers}
        return Models(made.get("llm"), made.get("embedding"), made.get("nli"))


def read_spec(path: str) -> Spec:
    """A run file; unknown keys and kinds, a lone half of the entailment pair, and a run without sources are errors before anything is read."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(raw) - _KEYS:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    if not raw.get("sources"):
        raise ValueError("a run needs sources")
    for s in raw["sources"]:
        if set(s) != {"kind", "root", "independence_group"} or s["kind"] != "local_files":
            raise ValueError(f"not a source: {s}")
    providers = []
    for part in ("llm", "embedding", "nli"):
        if part in raw:
            options = dict(raw[part])
            make(part, **options)
            providers.append((part, options.pop("kind"), tuple(sorted(options.items()))))
    if ("embedding" in raw) != ("nli" in raw):
        raise ValueError("embedding and nli go together")
    names = tuple(a["kind"] for a in raw.get("analysers", ()))
    if bad := set(names) - {"quote_verifier", "uncited_figures"}:
        raise ValueError(f"unknown analysers: {', '.join(sorted(bad))}")
    return Spec(raw["title"], raw.get("topic", raw["title"]), raw.get("target_minutes", 10), tuple(raw["sources"]), "nli" in raw, names, str(Path(path).parent), tuple(providers))


@dataclass
class Run:
    frames: dict[str, DataFrame]
    cache: StageCache
    failed: bool = False
    counts: dict[str, int] = field(default_factory=dict)


def _basis(kind: str, **known) -> F.Column:
    fields = {"kind": F.lit(kind), "wording": F.lit(None).cast("string"), "premise": F.lit(None).cast("struct<start:bigint,stop:bigint>"), "similarity_pm": F.lit(None).cast("int"), "entailment_pm": F.lit(None).cast("int"), "contradiction_pm": F.lit(None).cast("int")}
    return F.struct(*[(known.get(k, v)).alias(k) for k, v in fields.items()]).cast(BASIS)


def _nest(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """claim_id, text and the sorted set of evidence."""
    e = F.struct("chunk", "source", "independence_group", "stance", "basis")
    return evidence.groupBy("claim_id").agg(F.array_sort(F.collect_set(e)).alias("evidence")).join(texts, "claim_id").select("claim_id", "text", "evidence")


def extract(chunks: DataFrame, docs: DataFrame, models: Models = Models()) -> DataFrame:
    named = docs.select(F.col("id").alias("doc_id"), "source_id", F.col("source.independence_group").alias("independence_group"), "title", F.col("ord").alias("doc_ord"))
    rows = models.drafts(chunks).join(chunks.select("chunk_id", "doc_id", "chunk_ix", F.col("text").alias("passage"), "heading_path"), "chunk_id").join(named, "doc_id")
    rows = rows.where(claims.is_grounded("claim_text", "passage", F.concat_ws(" ", "title", F.array_join("heading_path", " "))))
    keyed = claims.with_key(rows)
    texts = keyed.groupBy("claim_id").agg(F.min_by("claim_text", F.struct("doc_ord", "chunk_ix", "draft_ix")).alias("text"))
    ev = keyed.select("claim_id", F.col("chunk_id").alias("chunk"), F.col("source_id").alias("source"), "independence_group", F.lit("supports").alias("stance"), F.lit(None).cast(BASIS).alias("basis"))
    return _nest(ev, texts)


def _flat(claim_rows: DataFrame) -> DataFrame:
    return claim_rows.select("claim_id", "text", F.explode("evidence").alias("e")).select("claim_id", "text", "e.chunk", "e.source", "e.independence_group", "e.stance", "e.basis")


def grounded(claim_rows: DataFrame, chunks: DataFrame, docs: DataFrame, models: Models = Models()) -> DataFrame:
    """Evidence whose own chunk entails the claim; names of the document and its headings go before each window."""
    flat = _flat(claim_rows)
    named = chunks.join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id").select("chunk_id", text.names_prefix("title", "heading_path").alias("names"))
    w = windows.windows(chunks).join(named, "chunk_id").withColumn("premise", F.concat("names", "premise"))
    judged = ground.judge(flat.select("claim_id", F.col("chunk").alias("chunk_id"), "text"), w, models=models)
    kept = ground.keep(judged).select("claim_id", F.col("chunk_id").alias("chunk"))
    return _nest(flat.drop("text").join(kept, ["claim_id", "chunk"], "left_semi"), claim_rows.select("claim_id", "text"))


def clustered(claim_rows: DataFrame, models: Models = Models()) -> DataFrame:
    """Claims of one meaning become their lead, with the others' evidence marked as merged."""
    edges = cluster.equivalent(cluster.nominated(claim_rows.select("claim_id", "text"), models=models), models=models)
    lead = cluster.clusters(edges).where("claim_id <> lead")
    mutual = edges.select(F.col("a").alias("lead"), F.col("b").alias("claim_id"), "mutual_pm").union(edges.select("b", "a", "mutual_pm"))
    joined = lead.join(mutual, ["lead", "claim_id"])
    flat = _flat(claim_rows).join(joined, "claim_id", "left")
    merged = F.when(F.col("lead").isNotNull(), _basis("merged", wording=F.col("text"), entailment_pm=F.col("mutual_pm"))).otherwise(F.col("basis"))
    ev = flat.withColumn("basis", merged).withColumn("claim_id", F.coalesce("lead", "claim_id")).drop("text", "lead", "mutual_pm")
    return _nest(ev, claim_rows.select("claim_id", "text"))


def scored(claim_rows: DataFrame, chunks: DataFrame, docs: DataFrame, models: Models = Models()) -> DataFrame:
    """Evidence for and against from windows of groups that do not back the claim yet."""
    group = docs.select(F.col("id").alias("doc_id"), F.col("source.independence_group").alias("grp"), F.col("source_id").alias("source"))
    w = windows.windows(chunks).join(chunks.select("chunk_id", "doc_id", F.col("span.start").alias("at")), "chunk_id").join(group, "doc_id")
    w = w.withColumn("id", F.xxhash64("chunk_id", "first", "n_sents", "slice"))
    c = claim_rows.withColumn("id", F.xxhash64("claim_id"))
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("at", "first", "n_sents", "slice"))
    corpus = models.with_vector(w.withColumn("ord", place.cast("bigint")), "premise").select("id", "ord", "vec", "grp")
    asking = models.with_vector(c.withColumn("grp", F.array_distinct("evidence.independence_group")), "text").select("id", "vec", "grp")
    best = vectors.top_k(asking, corpus, DEFAULT.retrieve_k, DEFAULT.retrieve_floor_pm, slots=models.slots)
    pairs = best.join(c.select(F.col("id").alias("qid"), "claim_id", F.col("text").alias("claim")), "qid").join(w.withColumnRenamed("id", "cid"), "cid")
    judged = stances.score(pairs.drop("sim_pm"), models=models)
    d = stances.deciding(judged.select("claim_id", "chunk_id", "stance", "sim_pm", "entail_pm", "contra_pm", "rank", "source", "grp", (F.col("at") + F.col("start")).alias("from"), (F.col("at") + F.col("stop")).alias("to")))
    premise = F.struct(F.col("from").alias("start"), F.col("to").alias("stop"))
    new = d.select("claim_id", F.col("chunk_id").alias("chunk"), "source", F.col("grp").alias("independence_group"), "stance", _basis("nli", premise=premise, similarity_pm=F.col("sim_pm"), entailment_pm=F.col("entail_pm"), contradiction_pm=F.col("contra_pm")).alias("basis"))
    return _nest(_flat(claim_rows).drop("text").unionByName(new), claim_rows.select("claim_id", "text"))


def write_script(ledger_rows: DataFrame, chunks: DataFrame, docs: DataFrame, topic: str) -> DataFrame:
    """The stand-in writer: an opening that quotes the first sentence of the first source, a turn for each usable claim in the order of the sources, a sign-off."""
    order = docs.select(F.col("id").alias("doc_id"), F.col("ord").alias("doc_ord"))
    placed = chunks.join(order, "doc_id").select("chunk_id", "doc_id", "span", "text", "doc_ord", "chunk_ix")
    first = placed.orderBy("doc_ord", "chunk_ix").limit(1).select(F.get(text.sentences("text"), F.lit(0)).alias("q"), "doc_id", "span", "text")
    span = F.struct(F.col("span.start").alias("start"), (F.col("span.start") + F.octet_length("q")).alias("stop"))
    opening = first.select(F.lit(0).alias("turn"), F.lit("host").alias("speaker"), F.concat(F.lit(f"Today: {topic}. A source says: “"), "q", F.lit("”")).alias("text"), F.array().cast("array<string>").alias("citations"), F.array(F.struct(F.col("doc_id").alias("document"), span.alias("span"), F.col("q").alias("text"))).alias("quotes"))
    lead = F.create_map(*[F.lit(x) for x in ("corroborated", "Independent sources agree", "single_source", "One source reports", "contested", "The sources disagree here")])
    usable = ledger_rows.where("status <> 'unsupported'").join(ledger.first_appearance(ledger_rows, placed, "doc_ord", "chunk_ix"), "claim_id")
    ix = F.row_number().over(Window.orderBy(F.col("doc_ord").asc_nulls_last(), "chunk_ix", "claim_id"))  # a ledger's usable claims are one script
    told = usable.select((ix).alias("turn"), F.when((ix - 1) % 2 == 0, "guest").otherwise("host").alias("speaker"), F.concat(lead[F.col("status")], F.lit(": "), text.strip_marks("text")).alias("text"), F.array("claim_id").alias("citations"), F.array().cast(opening.schema["quotes"].dataType).alias("quotes"))
    end = usable.agg((F.count("*") + 1).cast("int").alias("turn")).select("turn", F.lit("host").alias("speaker"), F.lit("That is what the sources say.").alias("text"), F.array().cast("array<string>").alias("citations"), F.array().cast(opening.schema["quotes"].dataType).alias("quotes"))
    return opening.unionByName(told).unionByName(end)


def drafted(ledger_rows: DataFrame, chunks: DataFrame, docs: DataFrame, verdicts: DataFrame, topic: str, llm: Llm) -> DataFrame:
    """The turns that a model writes from the ledger and the numbered sources of its evidence: one request, whose draft must pass every check of ``references.build``; what is wrong goes into the next attempt."""
    spark = ledger_rows.sparkSession
    usable = ledger_rows.where("status <> 'unsupported'")
    cited = usable.select(F.explode("evidence.chunk").alias("chunk_id")).distinct()
    placed = chunks.join(cited, "chunk_id").join(docs.select(F.col("id").alias("doc_id"), F.col("ord").alias("doc_ord")), "doc_id")
    numbered = placed.withColumn("source_no", F.row_number().over(Window.orderBy("doc_ord", "chunk_ix")) - 1)  # the sources of one request
    sources = references.numbered(numbered.select("source_no", "doc_id", F.col("span.start").alias("start"), "text"))
    told = [r.asDict() for r in sources.select("source_no", "sent_no", "sentence").orderBy("source_no", "sent_no").collect()]  # what goes into one request
    view = [r.asDict() for r in script.ledger_view(usable, verdicts).orderBy("claim_id").collect()]
    schema = "script_id long, turn int, speaker string, text string, citations array<string>, refs array<struct<source_no:int,sent_no:int,part:string>>"

    def parse(reply: dict) -> list:
        turns = reply.get("turns") if isinstance(reply, dict) else None
        if not isinstance(turns, list) or not turns:
            raise ValueError("no turns")
        rows = [(0, i, t["speaker"], t["text"], list(t.get("citations", [])), [(r["source"], r["sentence"], r.get("part")) for r in t.get("refs", [])]) for i, t in enumerate(turns)]
        good, wrong = references.build(spark.createDataFrame(rows, schema), sources, ledger_rows)
        if bad := wrong.first():
            raise ValueError(f"turn {bad['turn']}: {bad['error']}")
        return good.drop("script_id").collect()

    rows = asked(llm, "script", parse)({"topic": topic, "sources": told, "ledger": view})
    return spark.createDataFrame(rows, ARTIFACTS["script"])


def analysed(turns: DataFrame, docs: DataFrame, which: tuple[str, ...]) -> DataFrame:
    """The findings of each analyser, or one note that it found none."""
    t = turns.withColumnRenamed("turn", "turn_id")
    parts = []
    for name in which:
        if name == "quote_verifier":
            f = analyse.quote_findings(t, docs.select(F.col("id").alias("doc_id"), "text")).select("severity", "turn_id", "message")
            clean = "quotes verified against their sources"
        else:
            f = analyse.uncited_figures(t).select(F.lit("warning").alias("severity"), "turn_id", "message")
            clean = "every turn that states a figure cites a claim"
        n = f.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("info").alias("severity"), F.lit(None).cast("int").alias("turn_id"), F.lit(clean).alias("message"))
        parts.append(f.unionByName(n).select(F.lit(name).alias("analyser"), "severity", F.col("turn_id").alias("turn"), "message"))
    out = turns.sparkSession.createDataFrame([], ARTIFACTS["analysis"])
    for p in parts:
        out = out.unionByName(p)
    return out


def run(spark: SparkSession, spec: Spec, cache_root: str) -> Run:
    """All artifacts of a run. It has failed if any finding is an error; the artifacts are there all the same."""
    ship(spark)
    cache = StageCache(cache_root)
    fetched = union_sources([local_files(spark, str(Path(spec.base) / s["root"]), s["independence_group"], s["root"]) for s in spec.sources])
    models = spec.models()
    # what a provider answers depends on which it is, so its stages are cached under it; keys stay out of fingerprints
    named = [[part, kind, [o for o in options if o[0] != "key"]] for part, kind, options in spec.providers]
    by = lambda *parts: [n for n in named if n[0] in parts]
    c = cache.cached

    def ingest():
        one = prepare.dedup_within_group(fetched, "source.independence_group", order="ord")
        return one.withColumn("id", prepare.document_id(F.col("source.connector"), F.col("source.locator"), F.col("text")))

    docs = c("ingest", 1, [fetched], ingest)

    def cut():
        rows = prepare.chunk_documents(docs, key="id").withColumnRenamed("id", "doc_id")
        return rows.withColumn("chunk_id", prepare.chunk_id("doc_id", F.col("span.start"), F.col("span.stop")))

    chunks = c("chunk", 1, [docs], cut)
    rows = c("extract_claims", 1, [chunks, docs], lambda: extract(chunks, docs, models), by("llm"))
    if spec.entailment:
        before = rows
        rows = c("ground_claims", 1, [before, chunks, docs], lambda: grounded(before, chunks, docs, models), by("embedding", "nli"))
        kept = rows
        rows = c("cluster_claims", 1, [kept], lambda: clustered(kept, models), by("embedding", "nli"))
        merged = rows
        rows = c("score_stances", 1, [merged, chunks, docs], lambda: scored(merged, chunks, docs, models), by("embedding", "nli"))
    final = rows
    book = c("ledger", 1, [final], lambda: ledger.classify(final, fold=False))
    verdicts = c("adjudicate", 1, [book], lambda: adjudicate.verdicts(book.where("status = 'contested'"), chunks, docs.withColumnRenamed("id", "doc_id"), models.llm), by("llm"))
    turns = c("script", 1, [book, chunks, docs], lambda: drafted(book, chunks, docs, verdicts, spec.topic, models.llm) if models.llm else write_script(book, chunks, docs, spec.topic), [spec.topic, *by("llm")])
    if models.llm is not None and hasattr(models.llm, "unload"):
        models.llm.unload()
    findings = c("analyse", 1, [turns, docs], lambda: analysed(turns, docs, spec.analysers), spec.analysers)
    errors = findings.where("severity = 'error'").count()
    return Run({"documents": docs, "chunks": chunks, "claims": final, "ledger": book, "verdicts": verdicts, "script": turns, "analysis": findings}, cache, bool(errors), {"errors": errors})


_ORDER = {"documents": ["ord"], "chunks": ["doc_id", "chunk_ix"], "claims": ["claim_id"], "ledger": ["claim_id"], "verdicts": ["claim_id"], "script": ["turn"], "analysis": ["analyser", "turn"]}


def write(result: Run, folder: str) -> None:
    """Every artifact as one JSON file."""
    for kind, df in result.frames.items():
        write_artifact(df.orderBy(*_ORDER[kind]), f"{folder}/{kind}.json", kind)
