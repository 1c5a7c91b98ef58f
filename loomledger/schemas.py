"""The rows of each artifact."""

from __future__ import annotations

SPAN = "struct<start:bigint,stop:bigint>"
BASIS = f"struct<kind:string,wording:string,premise:{SPAN},similarity_pm:int,entailment_pm:int,contradiction_pm:int>"
EVIDENCE = f"struct<chunk:string,source:string,independence_group:string,stance:string,basis:{BASIS}>"
QUOTE = f"struct<document:string,span:{SPAN},text:string>"
ARTIFACTS = {
    "documents": "id string, source struct<connector:string,locator:string,independence_group:string>, source_id string, title string, text string, ord bigint",
    "chunks": f"chunk_id string, doc_id string, chunk_ix int, span {SPAN}, heading_path array<string>, text string",
    "claims": f"claim_id string, text string, evidence array<{EVIDENCE}>",
    "ledger": f"claim_id string, text string, evidence array<{EVIDENCE}>, status string, groups array<string>, grp string, supporting array<string>, contradicting array<string>",
    "verdicts": "claim_id string, favours string, explanation string, cites array<string>",
    "script": f"turn int, speaker string, text string, citations array<string>, quotes array<{QUOTE}>",
    "analysis": "analyser string, severity string, turn int, message string",
}
