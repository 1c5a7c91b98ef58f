"""Word lists of the scripts that are written without spaces, out of the dictionaries that Spark's own ICU library ships.

Chinese and Japanese words come with a cost (the rarer the dearer), those of Thai, Lao, Khmer and Burmese without one. The file format is public: a header, eight numbers,
and a trie of bytes or of UTF-16 units whose nodes are branches, runs and values. The driver sends the tries as they are, 3 MB, and a lattice walks them; nothing is copied into this repository. Beside them stand the few word classes
that decide a gap, and words in と that the dictionary lacks, written by hand.
"""

from __future__ import annotations

import glob
import os
import struct
import zipfile
from functools import lru_cache

FOLDER = "com/ibm/icu/impl/data/icudata/brkitr/"
#: By script: the dictionary's name.
FILES = {"east": "cjdict", "thai": "thaidict", "lao": "laodict", "khmer": "khmerdict", "burmese": "burmesedict"}


class _Layout:
    """Fixed values of the two kinds of trie: where kinds of nodes and lengths of numbers begin."""

    def __init__(self, run: int, value: int, value_steps: tuple[int, ...], delta_steps: tuple[int, ...], bits: int):
        self.run, self.value, self.value_steps, self.delta_steps, self.bits = run, value, value_steps, delta_steps, bits


#: The first lead of two, three, ... units; the last step is a lead that holds no part of the number itself.
BYTES = _Layout(0x10, 0x20, (0x51, 0x6C, 0x7E, 0x7F), (0xC0, 0xF0, 0xFE, 0xFF), 8)
UNITS = _Layout(0x30, 0x40, (0x4000, 0x7FFF), (0xFC00, 0xFFFF), 16)
NODE_VALUE = (0x4040, 0x7FC0)


class Trie:
    def __init__(self, units, layout: _Layout):
        self.u, self.layout, self.wide = units, layout, layout.bits == 16

    def _number(self, lead: int, at: int, steps: tuple[int, ...], base: int = 0) -> tuple[int, int]:
        """(number, place after it) of a number whose lead unit is taken."""
        k = sum(lead >= s for s in steps)
        if not k:
            return lead - base, at
        plain = len(steps) - (1 if self.wide else 2)
        n = lead - steps[k - 1] if k <= plain else 0
        for j in range(k):
            n = n << self.layout.bits | self.u[at + j]
        return n, at + k

    def _value(self, node: int, at: int) -> tuple[int, int]:
        """Of a final value, or of the distance in a branch's list."""
        if self.wide:
            return self._number(node & 0x7FFF, at, self.layout.value_steps)
        return self._number(node >> 1, at, self.layout.value_steps, 0x10)

    def _final(self, node: int) -> bool:
        return bool(node & 0x8000) if self.wide else bool(node & 1)

    def step(self, at: int, left: int, unit: int) -> tuple[int, int, int | None] | None:
        """From a place with so many units of a run left, on by one unit: (place, units left, value if a word ends here); place -1 where no word goes on. None where no word has it."""
        u = self.u
        if not left:
            node = u[at]
            at += 1
            if node >= self.layout.value:  # a word ends here and others go on
                if not self.wide:
                    _, at = self._value(node, at)
                    node = u[at]
                    at += 1
                else:
                    lead = node & 0x7FC0
                    at += 0 if lead < NODE_VALUE[0] else 1 if lead < NODE_VALUE[1] else 2
                    node &= 0x3F
            if node >= self.layout.run:
                left = node - self.layout.run + 1
            else:
                n = node
                if not n:
                    n, at = u[at], at + 1
                n += 1
                while n > 5:
                    less = unit < u[at]
                    delta, after = self._number(u[at + 1], at + 2, self.layout.delta_steps)
                    at, n = (after + delta, n >> 1) if less else (after, n - (n >> 1))
                for last in range(n - 1, -1, -1):
                    key, at = u[at], at + 1
                    if not last:
                        return self._here(at, 0) if key == unit else None
                    node, at = u[at], at + 1
                    value, at = self._value(node, at)
                    if key == unit:
                        return (-1, 0, value) if self._final(node) else self._here(at + value, 0)
        return self._here(at + 1, left - 1) if u[at] == unit else None

    def _here(self, at: int, left: int) -> tuple[int, int, int | None]:
        if left or self.u[at] < self.layout.value:
            return at, left, None
        node = self.u[at]
        if self._final(node):
            return -1, 0, self._value(node, at + 1)[0]
        if not self.wide:
            return at, 0, self._value(node, at + 1)[0]
        lead = node & 0x7FC0
        if lead < NODE_VALUE[0]:
            return at, 0, (lead >> 6) - 1
        return at, 0, (lead - NODE_VALUE[0]) << 10 | self.u[at + 1] if lead < NODE_VALUE[1] else self.u[at + 1] << 16 | self.u[at + 2]

    def words(self):
        """(units, value) of all words."""
        stack = [(0, ())]
        while stack:
            at, prefix = stack.pop()
            node = self.u[at]
            at += 1
            if node >= self.layout.value:
                final = self._final(node)
                if final or not self.wide:
                    value, at = self._value(node, at)
                else:
                    lead = node & 0x7FC0
                    if lead < NODE_VALUE[0]:
                        value = (lead >> 6) - 1
                    elif lead < NODE_VALUE[1]:
                        value, at = (lead - NODE_VALUE[0]) << 10 | self.u[at], at + 1
                    else:
                        value, at = self.u[at] << 16 | self.u[at + 1], at + 2
                yield prefix, value
                if final:
                    continue
                if not self.wide:
                    stack.append((at, prefix))
                    continue
                node &= 0x3F
            if node >= self.layout.run:
                n = node - self.layout.run + 1
                stack.append((at + n, (*prefix, *self.u[at : at + n])))
                continue
            n = node
            if not n:
                n, at = self.u[at], at + 1
            parts = [(at, n + 1)]
            while parts:
                at, n = parts.pop()
                while n > 5:
                    lead, at = self.u[at + 1], at + 2
                    delta, at = self._number(lead, at, self.layout.delta_steps)
                    parts.append((at + delta, n >> 1))
                    n -= n >> 1
                for last in range(n - 1, -1, -1):
                    unit, at = self.u[at], at + 1
                    if not last:
                        stack.append((at, (*prefix, unit)))
                        break
                    node, at = self.u[at], at + 1
                    value, at = self._value(node, at)
                    if self._final(node):
                        yield (*prefix, unit), value
                    else:
                        stack.append((at + value, (*prefix, unit)))


def library() -> str:
    """Spark's ICU library, beside the Python package or in SPARK_HOME."""
    import pyspark

    for home in (os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")):
        found = glob.glob(os.path.join(home, "jars", "icu4j-*.jar"))
        if found:
            return found[0]
    raise FileNotFoundError("no icu4j library in Spark's jars: give the path of one")


@lru_cache(maxsize=8)
def raw(script: str, path: str | None = None) -> bytes:
    """A script's dictionary as it is in the library."""
    with zipfile.ZipFile(path or library()) as z:
        return z.read(f"{FOLDER}{FILES[script]}.dict")


class Dictionary:
    """The words of a script with their costs (0 where the dictionary has none)."""

    def __init__(self, data: bytes):
        body = data[struct.unpack(">H", data[:2])[0] :]
        numbers = struct.unpack(">8i", body[:32])
        trie = body[numbers[0] :]
        self.first = numbers[5] & 0x1FFFFF
        self.wide = bool(numbers[4] & 7)
        self.steps: dict = {}
        self.trie = Trie(struct.unpack(f">{len(trie) // 2}H", trie[: len(trie) // 2 * 2]), UNITS) if self.wide else Trie(trie, BYTES)

    def units(self, ch: str) -> tuple[int, ...]:
        if self.wide:
            return (ord(ch),) if ch <= "\uffff" else struct.unpack(">2H", ch.encode("utf-16-be"))
        k = 0xFF if ch == "\u200d" else 0xFE if ch == "\u200c" else ord(ch) - self.first
        return (k,) if 0 <= k <= 0xFF else (-1,)

    def beginning(self, text: str, at: int) -> dict[int, int]:
        """By their stop: the costs of the words that begin at a place of a text. Steps that were taken before are remembered."""
        out: dict[int, int] = {}
        state = (0, 0)
        known = self.steps
        for stop in range(at, len(text)):
            ch = text[stop]
            found = known.get((state, ch), 0)
            if found == 0:
                found = known[state, ch] = self._over(state, ch)
            if found is None:
                break
            state, value = found
            if value is not None:
                out[stop + 1] = value
            if state[0] < 0:
                break
        return out

    def _over(self, state: tuple[int, int], ch: str) -> tuple[tuple[int, int], int | None] | None:
        if len(self.steps) > 1_000_000:
            self.steps.clear()
        value = None
        for unit in self.units(ch):
            found = self.trie.step(*state, unit) if state[0] >= 0 else None
            if found is None:
                return None
            state, value = found[:2], found[2]
        return state, value

    def words(self) -> dict[str, int]:
        """All of them."""
        if self.wide:
            return {b"".join(u.to_bytes(2, "big") for u in w).decode("utf-16-be"): v for w, v in self.trie.words()}
        return {"".join("\u200d" if b == 0xFF else "\u200c" if b == 0xFE else chr(self.first + b) for b in w): 0 for w, _ in self.trie.words()}


@lru_cache(maxsize=2)
def confusables(path: str | None = None) -> dict[str, str]:
    """Characters and what they look like, by the Unicode consortium's table in the same library: keys of code point and length, then places in a table of strings."""
    with zipfile.ZipFile(path or library()) as z:
        raw = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    _, _, _, keys, n, places, _, strings, m = struct.unpack(">9I", body[:36])
    table = body[strings : strings + 2 * m].decode("utf-16-be", "surrogatepass")
    out = {}
    for i in range(n):
        (key,) = struct.unpack_from(">I", body, keys + 4 * i)
        (at,) = struct.unpack_from(">H", body, places + 2 * i)
        length = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(at) if length == 1 else table[at : at + length]
    return out


#: Japanese words that begin with と and can begin a sentence.
JA_TO = """とにかく とても ところが ところで ところどころ とうとう とはいえ とはいうものの とりあえず とりわけ ともかく ともあれ ともに ともども とんでもない とたんに とっくに とっさに とつぜん
とっても とびきり とびら とびらが とまどい とまり とまれ となり となりの となると とすると とすれば としたら としても として としょかん としより とけい ところ とおく とおい とおり とおりに ともだち とんぼ とんび とかげ
とくに とくべつ とくい とちゅう とちゅうで とどまる とどけ とびだす とりで とりに とりが ときどき ときおり ときには ときに ときたま とじこめ とうぜん とうじ とうだい とうげ とうさん とうちゃん とうふ とうめい とうてい
とことん とめどなく とめて とろり とろとろ とぼとぼ とんとん とんと とんだ とわに とかく とかい とたん とだな とばり とげ とこや とこしえ とある
とき とし とり とも とら とち""".split()
#: Particles that report what was quoted before them, by whether a verb of saying must follow; stems of such verbs.
JA_REPORT = {"という": False, "といった": False, "などと": False, "って": False, "とは": True, "と": True}
JA_SAY = """言 云 尋 訊 聞 問 答 叫 呼 話 語 述 伝 告 呟 囁 思 考 書 記 頼 命 説明 報告 怒鳴 笑 返 続け 主張 指摘 声 繰 願 誓 約束 感 信 教え 注意 警告 促 誘 勧 励 慰 諭 叱 嘆 泣 唸 唱 読 挨拶 宣言 発表 提案 質問 断 認 加え 申 仰
いう いった いって いい つぶや ささや どな きい たずね こたえ さけ おっしゃ おも うなず""".split()
#: Forms of verbs of saying in kana, which the dictionary has only in part.
JA_KANA = "きいた きいて きく きかれた きかれて いわれた いわれて おもう おもった おもって こたえた こたえて さけんだ さけんで ささやいて ささやいた たずねた たずねて もらした もらして よんだ よんで つぶやいて つぶやいた いった いって".split()
ZH_SAY = {"问道", "说道", "喊道", "叫道", "答道", "写道", "回答", "说", "问", "喊", "叫", "道", "問道", "說道", "寫道", "說", "問"}
#: Words that end a sentence by themselves, and words that open one.
FINAL = {"east": {"です", "ます", "た", "だ", "か", "ね", "よ", "わ", "ない", "了", "吗", "呢", "吧", "啊", "嗎"}, "thai": {"ครับ", "ค่ะ", "คะ", "นะ", "แล้ว", "ไป", "มา", "ไหม", "เลย", "ด้วย", "จ้ะ", "จ้า"}, "lao": {"ແລ້ວ", "ໄປ", "ມາ", "ບໍ່", "ເດີ"}, "khmer": {"ហើយ", "ទេ", "ណាស់"}, "burmese": {"တယ်", "သည်", "ပါ", "ဘူး", "မယ်", "လား"}}
OPENING = {"east": {"しかし", "そして", "だから", "また", "でも", "それ", "この", "その", "但是", "然而", "所以", "因为", "后来", "据"}, "thai": {"ใน", "เมื่อ", "แต่", "และ", "เขา", "เธอ", "ถ้า", "เพราะ", "จาก", "ไม่", "ไม่มี"}, "lao": {"ໃນ", "ແຕ່", "ແລະ", "ລາວ", "ຖ້າ"}, "khmer": {"នៅ", "ប៉ុន្តែ", "និង", "គាត់"}, "burmese": {"သို့သော်", "သူ", "ဤ"}}


class Lattice:
    """The cheapest way through the words that a text can be made of. A character of no word costs more than any word."""

    UNKNOWN, PLAIN = 260, 60

    def __init__(self, script: str, data: bytes | None):
        """``data``: a dictionary; without one no word is known."""
        self.script = script
        self.listed = Dictionary(data) if data else None
        self.own = {*FINAL[script], *OPENING[script], *((*JA_TO, *JA_KANA, *JA_REPORT, *ZH_SAY) if script == "east" else ())} if data else set()
        self.longest, self.heads = max(map(len, self.own), default=0), {w[0] for w in self.own}
        self.cut = lru_cache(maxsize=50_000)(self._cut)

    def words_at(self, text: str, i: int) -> dict[int, int]:
        """By their stop: the costs of the words that begin at ``i``."""
        out = {j: self.PLAIN for j in range(i + 1, min(len(text), i + self.longest) + 1) if text[i:j] in self.own} if text[i] in self.heads else {}
        for j, c in self.listed.beginning(text, i).items() if self.listed else ():
            out[j] = c or self.PLAIN
        return out

    def _cut(self, text: str) -> list[tuple[str, bool]]:
        """The words, and whether each is known."""
        n = len(text)
        best: list[float] = [0.0] + [float("inf")] * n
        back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
        for i in range(n):
            found = self.words_at(text, i)
            for j, c in found.items() if i + 1 in found else ((i + 1, self.UNKNOWN), *found.items()):
                if best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, (i, j in found)
        out = []
        while n:
            i, known = back[n]
            out.append((text[i:n], known))
            n = i
        return out[::-1]
