"""Text garbled by a wrong character encoding: finding it and restoring it by minimum description length.

For each labelled language, whatever their number, a zstandard dictionary is trained on a bounded sample of labelled texts (SAMPLE_DOCS documents a
language, those of the smallest hashes). The characters usual in a language are counted over all documents; to those of a language of few documents come the ones that are
usual in larger languages of its script. A text with a
character that is not usual in its language, or stands in an odd place, is suspect; every chain of decodings that explains
a suspect character is applied, the words touched are compressed with the language's dictionary, and the chain of least
total length, the cost of naming it included, wins if that is less than the length of the text as it is; otherwise the text
is left alone. Chains are applied again to their result, for text garbled more than once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from heapq import heappop, heappush

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Bound of the training sample: documents of a language, characters of a document, languages at a time.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 400, 4000, 32
#: Languages of fewer documents (or of fewer than the largest has) take the usual characters of their script, too.
TINY = 30
#: Different letters beyond ASCII that a text of another script than Latin has at least, on average.
SCRIPT_LETTERS = 8
#: Size of a dictionary, and the share of a language's documents from which on a character is usual in it.
DICT_BYTES, USUAL = 64 * 1024, 0.05
#: Bytes that it costs to name a decoding among some two hundred, to say that a text is garbled at all, and to describe a
#: line in another language than its text's.
NAME, GARBLED, TONGUE_COST = 1, 1, 1
#: Usual characters of a language that take one byte, and the level of compression.
ONE_BYTE, LEVEL = 96, 9
#: Decisions and words remembered by a task, and the longest word remembered.
SEEN, WORDS, WORD_CHARS = 20_000, 100_000, 64

# ISO 639 codes that name no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "")
# Single-byte encodings that text is often read in by mistake, or was written in.
READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac-roman", "mac-latin2", "cp1254", "cp1257")
WRITTEN_IN = ("cp1252", "mac-roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp852", "mac-latin2", "cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")

# One valid multi-byte sequence of UTF-8, its bytes lifted to characters.
_utf8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_word = re.compile(r"[^\x00-\x20]+")
# Marks that join words.
JOINING = "’–—…·\xad\u200b\u200c\u200d\u2060"
_gap = re.compile("[\x00-\x20]+")
_entity = re.compile(r"&#?\w{1,31};")
_broken = re.compile("[\x80-\x84\x86-\x9f�]")


@cache
def lift(encoding: str, lowered: bool = False) -> dict[int, str]:
    """Character -> the character of the byte it was read from. Bytes without a character pass through. `lowered`: for
    text that was put into lower case after it was garbled."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ord(ch), chr(b))
        if not 0x80 <= ord(ch) < 0xA0:
            out.setdefault(b, chr(b)) if b < 0xA0 else None
    if lowered:
        out |= {ord(chr(c).lower()): b for c, b in list(out.items()) if ("\xc2" <= b <= "\xdf" or "\x80" <= b <= "\x9f") and chr(c).lower() != chr(c)}
    return out


@cache
def swap(read_as: str, written_in: str) -> dict[int, str]:
    """Character -> the character its byte means in the encoding the text was written in; only differing ones."""
    out = {}
    for c, b in lift(read_as).items():
        try:
            right = b.encode("latin-1").decode(written_in)
        except UnicodeDecodeError:
            continue
        if right != chr(c) and right.isprintable():
            out[c] = right
    return out


def misread(text: str, read_as: str = "cp1252") -> str:
    """Text in UTF-8 as it looks when read in a single-byte encoding; bytes without a character there stay C1 controls."""
    back = {b: chr(c) for c, b in lift(read_as).items()}
    return "".join([b if b < "\x80" else back.get(b, b) for b in text.encode("utf-8").decode("latin-1")])


class Lifted(dict):
    """Character -> the character of its byte; ASCII is its own, and what no byte was read as is none."""

    def __missing__(self, n: int) -> str:
        self[n] = out = chr(n) if n < 0x80 else "Ā"
        return out


class Chain:
    """One decoding: UTF-8 read in a single-byte encoding (`written_in` None), or one such encoding read in another."""

    def __init__(self, read_as: str, written_in: str | None = None, lowered: bool = False):
        self.name = f"{read_as}{'-lowered' if lowered else ''}>{written_in or 'utf-8'}"
        if written_in:
            self.table = swap(read_as, written_in)
            self.leads = frozenset(map(chr, self.table))
        else:
            self.table = lift(read_as, lowered)
            self.leads = frozenset(chr(c) for c, b in self.table.items() if "\xc2" <= b <= "\xf4")
        self.multi = written_in is None
        self.lifted = Lifted({c: b for c, b in self.table.items() if c >= 0x80}) if self.multi else None

    @classmethod
    def part(cls, chain: Chain, only: set[str]) -> Chain:
        """A single-byte chain applied to some characters only."""
        out = cls.__new__(cls)
        out.name, out.multi, out.lifted, out.leads = chain.name, False, None, chain.leads & only
        out.table = {c: to for c, to in chain.table.items() if chr(c) in only}
        return out

    def apply(self, text: str) -> str:
        if not self.multi:
            return text.translate(self.table)
        lifted = text.translate(self.lifted)  # same length as text
        parts, at = [], 0
        for m in _utf8.finditer(lifted):
            try:
                good = m.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            parts += [text[at : m.start()], good]
            at = m.end()
        return "".join([*parts, text[at:]]) if at else text


@cache
def _multi() -> list[Chain]:
    return [Chain(r) for r in READ_AS] + [Chain("cp1252", lowered=True), Chain("cp1250", lowered=True)]


@cache
def _single() -> list[Chain]:
    return [Chain(r, w) for r in READ_AS for w in WRITTEN_IN if r != w and swap(r, w)]


class Codes(dict):
    """Code point -> code; ASCII is its own, and what isn't listed takes the long codes."""

    def __missing__(self, n: int) -> str:
        self[n] = out = chr(n) if n < 0x80 else _rare(chr(n))
        return out


def _rare(ch: str) -> str:
    n = ord(ch)
    if n > 0xFFFF or ch == "�" or unicodedata.category(ch) in ("Cc", "Cn", "Co", "Cs"):
        return "\x05" + chr(n >> 16) + chr(n >> 8 & 255) + chr(n & 255)
    if unicodedata.category(ch)[0] in "PSZ":
        return "\x06" + chr((n ^ n >> 8) & 255)
    return "\x04" + chr(n >> 8) + chr(n & 255)


class Model:
    """Dictionaries and usual characters by language, and the code that text is packed in.

    The code states what a language expects: ASCII and the ONE_BYTE most frequent usual characters take one byte; further
    usual characters, their capitals, those usual in another language of the corpus, marks and symbols two; any other
    character three; what no rightly decoded text holds (C1 controls, replacement, private and unassigned characters) four.
    A capital after a small letter, a mark between two letters, a symbol after a letter, a letter beyond ASCII beside a
    digit, and a letter beside one of another script take a byte more. So a decoding gains by what
    the language and the dictionary know, not by the length of UTF-8.
    """

    def __init__(self, usual: dict[str, set[str]], counts: dict[tuple[str, str], int] | None = None):
        self.usual = usual
        n = counts or {}
        elsewhere = {ch: "\x03" + chr(0x20 + i) for i, ch in enumerate(sorted({ch for v in usual.values() for ch in v})[: 0x100 - 0x20])}
        self.codes: dict[str, Codes] = {}
        for k, v in usual.items():
            order = sorted(v, key=lambda ch: (-n.get((k, ch), 0), ch))
            own = {ch: chr(0x80 + i) if i < ONE_BYTE else chr(0x80 + ONE_BYTE + (i - ONE_BYTE) // 0xE0) + chr(0x20 + (i - ONE_BYTE) % 0xE0) for i, ch in enumerate(order[: ONE_BYTE + (0x80 - ONE_BYTE) * 0xE0])}
            capitals = {ch.upper(): "\x07" + code for ch, code in own.items() if len(ch.upper()) == 1 and ch.upper() != ch}
            self.codes[k] = Codes({ord(ch): code for ch, code in (elsewhere | capitals | own).items()})
        self.dicts: dict[str, bytes] = {}
        self._packers: dict[str, zstandard.ZstdCompressor] = {}
        self._seen: dict[tuple, tuple[Chain, ...] | bool] = {}

    def __getstate__(self):
        return self.__dict__ | {"_packers": {}, "_seen": {}}

    def encode(self, text: str, lang: str) -> bytes:
        return text.encode("latin-1") if text.isascii() else marked(text).translate(self.codes[lang]).encode("latin-1")

    def cached(self, before: str, tongues: list[str], odd: set[str], used: list[str]) -> tuple[Chain, ...]:
        """`_cheapest`, remembered for texts that come again, as menus and notices do."""
        return self._remembered((before, len(tongues), tongues[0], frozenset(odd), frozenset(used)), lambda: _cheapest(before, tongues, odd, self, used))

    def shortens(self, before: str, tongues: list[str], odd: set[str]) -> bool:
        """`_shortens`, remembered."""
        return self._remembered((before, len(tongues), tongues[0], frozenset(odd)), lambda: _shortens(before, tongues, odd, self))

    def _remembered(self, key: tuple, f: Callable):
        if key not in self._seen:
            if len(self._seen) >= SEEN:
                self._seen.clear()
            self._seen[key] = f()
        return self._seen[key]

    def length(self, text: str, lang: str) -> int:
        return self.packed(self.encode(text, lang), lang)

    def packed(self, code: bytes, lang: str) -> int:
        if lang not in self._packers:
            d = zstandard.ZstdCompressionDict(self.dicts[lang])
            d.precompute_compress(level=LEVEL)
            self._packers[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(self._packers[lang].compress(code))

    def language(self, text: str, hint: str | None) -> str:
        """The language whose dictionary packs the text best; the labelled one at a tie."""
        return min(self.dicts, key=lambda k: (self.length(text, k), k != hint, k))

    def suspects(self, text: str, lang: str) -> set[str]:
        """Letters and marks that are not usual in either case, and whatever stands in an odd place. Symbols elsewhere,
        combining marks, blanks and invisible characters are not suspect."""
        if text.isascii():
            return set()
        usual = self.usual[lang]
        odd = {ch for ch in set(text) if ch >= "\x80" and ch not in usual and ch.lower() not in usual and unicodedata.category(ch) not in ("Cf", "Mn", "Zs", "Sc", "Sk", "Sm", "So")}
        return odd | {ch for at in odd_places(text) for ch in text[at - 1 : at + 1] if ch >= "\x80"}


class Kinds(dict):
    """Code point -> what odd places tell apart: Latin (a, A in ASCII; b, B beyond), Cyrillic (c, C) and other (l, L) letters
    in small and capital, digits (1), symbols (y) and marks that don't join words (m) beyond ASCII."""

    def __missing__(self, n: int) -> str:
        ch = chr(n)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            small = "a" if n < 0x80 else "b" if n < 0x250 else "c" if 0x400 <= n < 0x500 else "l"
            out = small.upper() if ch.isupper() else small
        elif n < 0x80 or kind in ("Zs", "Zl", "Zp", "Mn") or ch in JOINING or ch.isspace():
            out = "1" if ch.isdigit() else " "
        else:
            out = "y" if kind[0] == "S" else "1" if ch.isalnum() else "m"
        self[n] = out
        return out


_kinds = Kinds()
_odd = re.compile("(?<=[abc])[BCL]|(?<=[abclABCL])(?:m(?=[abclABCL])|y)|(?<=[abAB])[cC]|(?<=[cC])[abAB]|(?<=1)[bclBCL]|[bclBCL](?=1)")


def odd_places(text: str) -> set[int]:
    """Where a capital beyond ASCII follows a small letter, a mark stands between two letters, a symbol follows a letter, a
    letter beyond ASCII is beside a digit, or the script changes inside a word."""
    return {m.start() + at for m in _word.finditer(text) if not m.group().isascii() for at in _odd_spots(m.group())}


def _odd_spots(word: str) -> tuple[int, ...]:
    """The odd places of one word. No place depends on other words."""
    return _spots(word) if len(word) <= WORD_CHARS else _spots.__wrapped__(word)


@lru_cache(maxsize=WORDS)
def _spots(word: str) -> tuple[int, ...]:
    return tuple([m.start() for m in _odd.finditer(word.translate(_kinds))])


def marked(text: str) -> str:
    """The text with a byte before each odd place."""
    if not (spots := odd_places(text)):
        return text
    cuts = [0, *sorted(spots), len(text)]
    return "\x01".join([text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])


def garbled(text: str, hint: str | None, model: Model) -> bool:
    """Whether `restore` finds the text garbled. The chain of least length isn't asked for, so the search ends with the first
    line that any chain shortens."""
    return restore(text, hint, model, whole=False)[0]


def restore(text: str, hint: str | None, model: Model, whole: bool = True) -> tuple[bool, str, str, int]:
    """(garbled, text with what can be restored, the chains applied, characters lost). Text that no chain shortens stays as
    it is. What nothing restores is priced by a chain of its own, which puts an unknown letter of one byte in the place of
    replacement characters and C1 controls. Not `whole`: only the first counts."""
    plain = html.unescape(text) if "&" in text and _entity.search(text) else text
    if plain.isascii():
        return False, text, "", 0
    lang = hint if hint in model.dicts else None
    if lang is None or model.suspects(plain, lang):
        lang = model.language(plain, hint)
    used: list[str] = []
    lines = plain.split("\n")
    if model.suspects(plain, lang):
        others = sorted(set(model.dicts) - {lang})  # a line may be a quotation
        # A line that a chain shortens doesn't end as it is, whatever is done before: where it stands so again, the chain, which
        # names used before make no dearer, still shortens it.
        if not whole and any(_shorter(line, [lang, *others], model) for line in sorted(set(lines), key=lambda x: (-len(odd_places(x)), x))):
            return True, text, "", 0
        # First the chains that explain the document as a whole, used where a line gains by them; then what lines still
        # need. Every step shortens the description, so the steps end.
        while True:
            odd = [i for i, x in enumerate(lines) if not x.isascii() and all(model.suspects(x, k) for k in (lang, *others))]
            chain = _best("\n".join(lines[i] for i in odd), [lang], model, used) if len(odd) > 1 else ()
            gains = {i: _gain(lines[i], decoded(lines[i], chain), lang, model) for i in odd if chain}
            if sum(n for n in gains.values() if n > 0) <= cost(chain, used):
                break
            for i, n in gains.items():
                lines[i] = decoded(lines[i], chain) if n > 0 else lines[i]
            used += [c.name for c in chain]
        for i, line in enumerate(lines):
            while (whole or used) and not line.isascii() and (chain := _best(line, [lang, *others], model, used)):
                line = lines[i] = decoded(line, chain)
                used += [c.name for c in chain]
    restored, lost = "\n".join(lines), 0
    if broken := "\n".join(line for line in lines if _broken.search(line)):
        if _gain(broken, _broken.sub("\x7f", broken), lang, model) > NAME + GARBLED:
            lost = len(_broken.findall(broken))
    if used and restored != plain:
        return True, restored, " ".join(dict.fromkeys(used)), lost
    return lost > 0, text, "", lost


def _gain(before: str, after: str, lang: str, model: Model) -> int:
    """Bytes by which the words beyond ASCII of a line get shorter."""
    return model.length(_odd_words(before), lang) - model.length(_odd_words(after, before), lang)


def _odd_words(text: str, before: str | None = None) -> str:
    """The words of a text with characters beyond ASCII, or of the decoded text in whose place such words stood before; each as
    often as it stands there."""
    if before is None:
        return " ".join([w for w in _word.findall(text) if not w.isascii()])
    old, new = _gap.split(before), _gap.split(text)
    if len(old) != len(new):
        return text
    return " ".join([b for a, b in zip(old, new, strict=True) if not a.isascii()])


def decoded(text: str, chain: tuple[Chain, ...]) -> str:
    for c in chain:
        text = c.apply(text)
    return text


def cost(chain: tuple[Chain, ...], used: list[str]) -> int:
    """Bytes that a chain of decodings costs: NAME for each that wasn't named before, and GARBLED for the first of a text."""
    new = {c.name for c in chain} - set(used)
    return NAME * len(new) + (GARBLED if new and not used else 0)


def _best(text: str, tongues: list[str], model: Model, used: list[str]) -> tuple[Chain, ...]:
    """The chain of decodings with the least description length, its cost included; none to leave the text alone. Each of
    the tongues may describe the text."""
    odd = model.suspects(text, tongues[0])
    if not odd:
        return ()
    return model.cached(_odd_words(text), tongues, odd, used)  # rightly decoded words, too: a chain must not spoil them


def _shorter(line: str, tongues: list[str], model: Model) -> bool:
    """Whether `_best` has a chain for a line of a text of which nothing was decoded yet."""
    odd = model.suspects(line, tongues[0])
    return bool(odd) and model.shortens(_odd_words(line), tongues, odd)


class Memo(dict):
    """What a function gives for each word it was asked for."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, word: str):
        self[word] = out = self.f(word)
        return out


class Words:
    """The words of a line and their lengths in the tongues. No decoding reaches over a blank, so words are decoded and coded
    once."""

    def __init__(self, before: str, tongues: list[str], model: Model):
        words = before.split(" ")
        place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.order = [place[w] for w in words]
        self.start = tuple(place)
        self.model = model
        self.codes = [(k, Memo(lambda w, k=k: model.encode(w, k)).__getitem__, TONGUE_COST if k != tongues[0] else 0) for k in tongues]

    def lengths(self, state: tuple[str, ...]) -> Iterator[int]:
        """The length in each tongue."""
        for k, code, more in self.codes:
            own = list(map(code, state))
            yield self.model.packed(b" ".join([own[i] for i in self.order]), k) + more


def _cheapest(before: str, tongues: list[str], odd: set[str], model: Model, used: list[str]) -> tuple[Chain, ...]:
    """Every decoding that explains a suspect character is packed in every tongue, as a whole and for the suspect characters
    only. Those of UTF-8 are carried on by all further ones as long as that changes a word; every text they lead to is packed
    once, at the cost of the cheapest chain to it."""
    line = Words(before, tongues, model)
    start = line.start

    def described(state: tuple[str, ...]) -> int:
        """The length in the language that packs the words best."""
        return min(line.lengths(state))

    best = (described(start), 0, start, ())
    chains = [(c, 0 if c.name in used else 1 << i, Memo(c.apply).__getitem__) for i, c in enumerate(_multi())]
    # Each step shortens the words, so the longest text that waits can't be reached again. Chains to a text are kept by the new
    # names they use; one whose names all stand in another costs no more than that, however it goes on.
    waiting: dict[tuple[str, ...], dict[int, tuple[Chain, ...]]] = {start: {0: ()}}
    heap = [(-sum(map(len, start)), start)]
    while heap:
        state = heappop(heap)[1]
        ways = waiting.pop(state)
        if state != start:
            chain = min(ways.values(), key=lambda c: (cost(c, used), len(c)))
            best = min(best, (described(state) + cost(chain, used), len(chain), state, chain), key=lambda x: x[:3])
        for c, name, apply in chains:
            after = tuple(map(apply, state))
            if after == state:
                continue
            if after not in waiting:
                waiting[after] = {}
                heappush(heap, (-sum(map(len, after)), after))
            there = waiting[after]
            for names, chain in ways.items():
                more = names | name
                if more in there:
                    there[more] = min(there[more], (*chain, c), key=len)
                elif not any(x & more == x for x in there):
                    for x in [x for x in there if x & more == more]:
                        del there[x]
                    there[more] = (*chain, c)
    for table, c in _swaps(before, odd, used):
        after = tuple([w.translate(table) for w in start])
        price = described(after) + cost((c,), used)
        if (price, 1, after) < best[:3]:
            best = (price, 1, after, (Chain.part(c, {chr(n) for n in table}),))
    return best[3]


def _swaps(before: str, odd: set[str], used: list[str]) -> Iterator[tuple[dict[int, str], Chain]]:
    """What chains of single bytes make of the characters held, which is all they do."""
    held = sorted({ch for ch in before if ch >= "\x80"})
    effects: dict[tuple, Chain] = {}
    for c in _single():
        if not odd.isdisjoint(c.leads):
            whole = tuple([c.table.get(ord(ch)) for ch in held])
            for effect in (whole, tuple([to if ch in odd else None for ch, to in zip(held, whole, strict=True)])):
                if effect not in effects or c.name in used:
                    effects[effect] = c
    for effect, c in effects.items():
        yield {ord(ch): to for ch, to in zip(held, effect, strict=True) if to}, c


def _shortens(before: str, tongues: list[str], odd: set[str], model: Model) -> bool:
    """Whether `_cheapest` has a chain, where none was used before: the first chain found that shortens the line will do, and if
    there is none, all were tried."""
    line = Words(before, tongues, model)
    now = min(line.lengths(line.start))
    chains = [(1 << i, Memo(c.apply).__getitem__) for i, c in enumerate(_multi())]
    # As in `_cheapest`, but a text is packed as soon as it is reached.
    shortest: dict[tuple[str, ...], int] = {}
    waiting: dict[tuple[str, ...], set[int]] = {line.start: {0}}
    heap = [(-sum(map(len, line.start)), line.start)]
    while heap:
        state = heappop(heap)[1]
        ways = waiting.pop(state)
        shortest.pop(state, None)
        for name, apply in chains:
            after = tuple(map(apply, state))
            if after == state:
                continue
            if after not in waiting:
                waiting[after] = set()
                heappush(heap, (-sum(map(len, after)), after))
                shortest[after] = min(line.lengths(after))
            there = waiting[after]
            for names in ways:
                more = names | name
                if not any(x & more == x for x in there):
                    there -= {x for x in there if x & more == more}
                    there.add(more)
                    if shortest[after] + NAME * more.bit_count() + GARBLED < now:
                        return True
    for table, _ in _swaps(before, odd, []):
        after = tuple([w.translate(table) for w in line.start])
        if any(n + NAME + GARBLED < now for n in line.lengths(after)):
            return True
    return False


def fit(docs: DataFrame, text: str, lang: str, doc_id: str) -> Model:
    """Dictionaries from the bounded sample, usual characters from all documents."""
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"), F.col(f"`{doc_id}`").alias("i")).where("t is not null and l is not null").where(~F.lower("l").isin(*NO_LANGUAGE))
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # a row for each label
    if not sizes:
        return Model({})
    tiny = {k for k, v in sizes.items() if v < min(TINY, max(sizes.values()))}
    marks = F.array_distinct(F.split(F.regexp_replace("t", r"[\x00-\x7f]", ""), ""))
    counts = rows.select("l", F.explode(marks).alias("ch")).where("ch <> ''").groupBy("l", "ch").count()
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, 1.0 if k in tiny else float(max(2, USUAL * v)))])
    usual: dict[str, set[str]] = {k: set() for k in sizes}
    scripts: dict[str, Counter] = {k: Counter() for k in sizes}
    found: dict[tuple[str, str], int] = {}
    for r in counts.where(F.col("count") >= F.element_at(share, F.col("l"))).collect():  # at most the alphabets in use
        if r["count"] >= max(2, USUAL * sizes[r.l]):
            usual[r.l].add(r.ch)
            found[r.l, r.ch] = r["count"]
        if r.ch.isalpha():
            scripts[r.l][_script(r.ch)] += r["count"]
    main = {k: next((x for x, n in c.most_common() if x != "LATIN" and n >= SCRIPT_LETTERS * sizes[k]), "LATIN") for k, c in scripts.items()}
    large = {k: set(v) for k, v in usual.items() if k not in tiny}
    for k in tiny:
        usual[k] |= {ch for other, v in large.items() if main[other] == main[k] for ch in v}
        if main[k] not in {main[x] for x in large} and main[k] != "LATIN":
            usual[k] |= {chr(c) for c in range(0x80, 0x10000) if chr(c).isalpha() and _script(chr(c)) == main[k]}
    model, names = Model(usual, found), sorted(sizes)
    for lo in range(0, len(names), LANGUAGES):  # so many samples are in the driver at once
        some = names[lo : lo + LANGUAGES]
        ranked = rows.where(F.col("l").isin(some) & ((F.length("t") > 100) | F.col("l").isin(sorted(tiny)))).withColumn("h", F.xxhash64("i"))
        # The smallest hashes of each language by a threshold on the hash, so no sort of all rows is needed.
        span = F.element_at(F.create_map(*[F.lit(x) for k in some for x in (k, min(1.0, 2.0 * SAMPLE_DOCS / sizes[k]))]), F.col("l"))
        ranked = ranked.where((F.col("h") / F.lit(2.0**64) + 0.5) < span).select("l", "h", F.substring("t", 1, SAMPLE_CHARS).alias("t"))
        sample: dict[str, list[tuple[int, str]]] = {k: [] for k in some}
        for r in ranked.collect():
            sample[r.l].append((r.h, r.t))
        for k, docs_ in sample.items():
            texts = [t for _, t in sorted(docs_)[:SAMPLE_DOCS] if not model.suspects(t, k)]
            if lines := [model.encode(x, k) for t in texts for x in t.split("\n") if x]:
                model.dicts[k] = _train(lines)
    return model


def _script(ch: str) -> str:
    return unicodedata.name(ch, "LATIN").split()[0]


def _train(lines: list[bytes]) -> bytes:
    size = min(DICT_BYTES, max(1024, sum(map(len, lines)) // 8))
    try:
        return zstandard.train_dictionary(size, lines, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text for training: the text itself is the dictionary
        return b"".join(lines)[-size:]


def garbled_texts(docs: DataFrame, text: str, lang: str, doc_id: str, model: Model | None = None) -> DataFrame:
    """(doc_id, restored, chains, lost) of every document with garbled text; `restored` is the text with what could be
    restored, `chains` names the decodings applied, empty where none was possible, `lost` counts the characters that
    nothing can restore (replacement characters and C1 controls).

    Null and empty texts are never garbled. Whole texts are read, whatever their length. An empty table gives no rows.
    Null or unknown languages are found from the text. Further columns are not read.
    """
    return _judged(docs, text, lang, doc_id, model, restore, {"restored": "string", "chains": "string", "lost": "int"})


def garbled_ids(docs: DataFrame, text: str, lang: str, doc_id: str, model: Model | None = None) -> DataFrame:
    """(doc_id) of the rows of `garbled_texts`, without restoring the texts."""
    return _judged(docs, text, lang, doc_id, model, lambda *x: (garbled(*x),), {})


def _judged(docs: DataFrame, text: str, lang: str, doc_id: str, model: Model | None, judge: Callable, more: dict[str, str]) -> DataFrame:
    """The id of every document that `judge` finds garbled, and the further columns it gives."""
    spark = docs.sparkSession
    model = model or fit(docs, text, lang, doc_id)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).where(F.col("t").rlike(r"[^\x00-\x7f]|&#?\w{1,31};"))
    out = ", ".join([f"`{doc_id}` {kind}", *[f"{k} {v}" for k, v in more.items()]])
    if not model.dicts:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(model)  # a dictionary of DICT_BYTES at most for each language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [(i, *judge(t, l, m)) for i, l, t in zip(b["i"], b["l"], b["t"], strict=True)]
            yield pd.DataFrame([(i, *x) for i, hit, *x in got if hit], columns=[doc_id, *more])

    return rows.mapInPandas(run, out)
