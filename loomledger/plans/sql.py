"""Pieces of SQL that state the engine's text functions for the checking engine."""

from __future__ import annotations

from loomledger.functions.speech import BRITISH_AMERICAN
from loomledger.functions.text import STOP_WORDS, WS

#: Marks that are part of a letter, of the scripts in the test tables, as a class of RE2.
_MARKS = r"\x{0345}\x{0900}-\x{0903}\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}\x{0E31}\x{0E34}-\x{0E3A}\x{0E4D}"
NOT_ALNUM = rf"[^\p{{L}}\p{{N}}{_MARKS}]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w_: w_ <> '')"


def pieces(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])({WS})', '\1' || chr(1) || '\2', 'g'), chr(1))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform({pieces(x)}, lambda p_: {trim('p_')}), lambda s_: s_ <> '')"


def content_words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex(lower({x}), '{NOT_ALNUM}'), lambda w_: w_ <> '' AND (length(w_) >= 3 OR regexp_matches(w_, '[0-9]')) AND w_ NOT IN ({_STOP}))))"


def numbers(x: str) -> str:
    return f"list_filter({content_words(x)}, lambda n_: regexp_matches(n_, '[0-9]'))"


def normalise(x: str) -> str:
    return f"lower({trim(f'regexp_replace({x}, ' + chr(39) + WS + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})"


def content_id(*parts: str) -> str:
    out = []
    for p in parts:
        p = f"coalesce(CAST({p} AS VARCHAR), '')"
        h = f"lpad(to_hex(octet_length(encode({p}))), 16, '0')"
        little = " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8))
        out += [f"unhex({little})", f"encode({p})"]
    return f"sha256({' || '.join(out)})"


def fold(x: str) -> str:
    return f"replace(lower({trim(x)}), '_', '-')"


def latest(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1)"


def per_mille(x: str) -> str:
    return f"CAST(round(greatest(0.0, least(1.0, {x})) * 1000) AS INTEGER)"


def groups(stance: str) -> str:
    own = f"list_transform(list_filter(evidence, lambda e_: e_.stance = '{stance}'), lambda e_: {fold('e_.independence_group')})"
    return f"list_sort(list_distinct(list_filter({own}, lambda g_: g_ IS NOT NULL AND g_ <> '')))"


LEDGER = f"""(SELECT claim_id, text, evidence, s_, c_, CASE WHEN len(c_) > 0 THEN 'contested' WHEN len(s_) > 1 THEN 'corroborated' WHEN len(s_) = 1 THEN 'single_source' ELSE 'unsupported' END AS status
 FROM (SELECT *, coalesce({groups('supports')}, []) AS s_, coalesce({groups('contradicts')}, []) AS c_ FROM claims))"""

#: Sentences with byte places: text_rows must give k (key) and t (text).
SPANS = f"""spans AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS sent_ix, sentence, start, start + octet_length(encode(sentence)) AS stop FROM (
 SELECT k, i, {trim('p')} AS sentence, sum(octet_length(encode(p))) OVER (PARTITION BY k ORDER BY i) - octet_length(encode(p)) + octet_length(encode(p)) - octet_length(encode(regexp_replace(p, '^{WS}+', ''))) AS start
 FROM (SELECT k, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT k, {pieces('t')} AS ps FROM text_rows WHERE t IS NOT NULL))) WHERE sentence <> '')"""


def nli(premise: str, hypothesis: str, prefix: str = "") -> str:
    """Columns entailment and contradiction of a select over p_ (premise words) and h_ (hypothesis words)."""
    p, h = f"{prefix}p_", f"{prefix}h_"
    num = "regexp_matches(n_, '[0-9]')"
    other, fig = f"list_filter({h}, lambda n_: NOT {num})", f"list_filter({h}, lambda n_: {num})"
    changed = f"(len(list_filter({fig}, lambda f_: NOT list_contains({p}, f_))) > 0 AND len(list_filter({p}, lambda n_: {num})) > 0 AND len(list_intersect({other}, {p})) >= 0.6 * len({other}))"
    return f"CASE WHEN len({h}) = 0 THEN 0.0 WHEN {changed} THEN 0.0 ELSE len(list_intersect({h}, {p})) / len({h}) END AS entailment, CASE WHEN len({h}) > 0 AND {changed} THEN 1.0 ELSE 0.0 END AS contradiction"


def slots(words_: str) -> str:
    return f"list_transform({words_}, lambda w_: CAST(('0x' || substr(md5(w_), 1, 4)) AS INTEGER) % 256)"


def slot_dot(a: str, b: str) -> str:
    return f"list_sum(list_concat([0], list_transform({a}, lambda x_: len(list_filter({b}, lambda y_: y_ = x_)))))"


def slot_cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {slot_dot(a, b)} / sqrt(CAST({slot_dot(a, a)} * {slot_dot(b, b)} AS DOUBLE)) ELSE 0.0 END"


def spoken_tokens(x: str) -> str:
    x = f"replace(replace(replace(lower({x}), '’', ''), '‘', ''), chr(39), '')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([0-9]),([0-9])', '\1\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([0-9])\.([0-9])', '\1 point \2', 'g')"
    x = f"replace(replace({x}, '%', ' percent '), '&', ' and ')"
    american = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in BRITISH_AMERICAN.items()) + "}"
    tokens = f"list_filter(string_split_regex({x}, '{NOT_ALNUM}'), lambda w_: w_ <> '')"
    tokens = rf"list_transform({tokens}, lambda w_: regexp_replace(w_, '^([0-9]+)(st|nd|rd|th)$', '\1'))"
    return f"list_transform({tokens}, lambda w_: coalesce(map_extract_value({american}, w_), w_))"
