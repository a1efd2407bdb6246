"""Sentences of documents in many languages and scripts.

1. Sources of lyrics: each line that is not blank is a sentence.  Elsewhere blank lines end sentences, lines
   of a list are sentences, and single line breaks are white space.
2. In a paragraph every mark that may end a sentence is a candidate.  Marks within quotations and brackets
   are none; marks of scripts without case or blanks (。！？।॥) always end one, a full stop before a
   small letter, after an initial or inside a number never does.
3. What stays open is settled within the document first: a word is an abbreviation if the document goes on
   in small letters after its full stop and never writes it without one; a word after an abbreviation
   starts a sentence if the document also writes it in small letters, and is a name if it has a capital
   inside a sentence.  Where the document says nothing, counts over the corpus do: words that are written
   small, abbreviations (words
   whose full stop is mostly followed by a small letter), openings of paragraphs (for sentences that start
   small) and endings of paragraphs without a mark (for sentences that lack one).

Corpus entries count from ``LEAST_SEEN`` sightings on, whatever the size of the corpus.  Those seen in one of
``RARITY`` paragraphs are sent to all tasks: at most some RARITY times the words of a paragraph.  The rarer ones
are joined to the documents that hold them; a filter of at most 32 MB keeps other words out of that join.

Edge cases: null, empty and blank texts have no sentences; repeated documents are documents; an unclosed
quotation ends with its paragraph; very long texts are read in one pass.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread

LYRICS = ("lrclib", "genius")
LEAST_SEEN, RARITY, GOES_SHARE = 5, 20_000, 0.3
#: Bits of the filter of rare entries, per entry and at most.
FILTER_BITS, MOST_BITS, CHUNK = 16, 1 << 28, 1 << 16

#: Abbreviations that stand before a name, so that a capital says nothing (fixed values).
TITLES = frozenset("dr mr mrs ms prof st sr sra srta m mm mme mlle hr hrn fr rev gen col capt lt sgt jr mt no nr vol p pp s ca approx cf vgl vs feat ft e.g i.e z.b u.a d.h bzw art fig n° डॉ श्री ดร د أ г ул им проф env av núm num pág".split())
#: Other abbreviations; a capitalised common word after one starts a sentence (fixed values).
ABBREVIATIONS = frozenset("etc co ltd inc bros corp rd ave blvd jan feb mar apr jun jul aug sep sept oct nov dec usw u.s u.k u.s.a a.m p.m ex т.е т.п т.д тыс млн руб ок др пр ud uds aprox est min max".split())
#: Words that start sentences and are no names (fixed values).
OPENERS = frozenset("the a an it he she they we you i this that these those there in on at of for with and but or so if when as by from to is was no not one two its his her their our my every all half few some what who how why where does did do are der die das ein eine es er sie wir ihr und aber in im am an auf für mit le la les un une il elle on nous vous ils et mais ce cette en el los las una y pero se su en no qué qu quel quelle selon was wer wie".split())
#: Particles that end sentences where neither marks nor capitals do (fixed values).
THAI_END = re.compile(r"(?:(?:ครับผม|ครับ|ค่ะ)(?=\s|[ก-๿A-Za-z0-9]|$)|(?:นะคะ|คะ|จ้ะ|จ้า)(?=\s|$))")

BREAK = re.compile(r"\r\n|\r|\n")
LIST_LINE = re.compile(r"\s*(?:[-•*–·▪◦]|\d{1,3}[.)])\s+\S")
EMOJI = "\U0001F000-\U0001FAFF☀-➿⬀-⯿️‍\U0001F3FB-\U0001F3FF"
CLOSERS = "\"'”’»)\\]」』】）》›"
HARD = "。！？｡।॥"
MARK = re.compile(f"[.!?…؟۔{HARD}]+")
AFTER = re.compile(f"[{CLOSERS}.!?…؟۔{HARD}]*(?:\\s*[{EMOJI}]+)*")
EMOJI_RUN = re.compile(f"[{EMOJI}]+")
OPEN_CLOSE = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "《": "》", "【": "】", "‹": "›"}
PAIRED = re.compile("[“”„«»「」『』()\\[\\]（）《》【】‹›\"]")
TOKEN_BEFORE = re.compile(r"[^\s\"“”«»「」()\[\]（）《》]*$")
AROUND = "-–—'’,;:@"
NEXT_WORD = re.compile(r"\s*[\"“«「('‘¡¿\[—–-]*\s*([^\W_]+(?:['’][^\W_]+)*)?")
WORD = re.compile(r"[^\s]+")
CASELESS = re.compile("[぀-ヿ㐀-鿿가-힯฀-๿ऀ-ॿ؀-ۿ֐-׿]")
REPEATS = re.compile(r"(\w)\1{2,}")
#: A short word with a full stop and what follows; a word without a full stop; a capitalised word inside a sentence.
STOP = re.compile(r"(?<![^\W_])([^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_])){0,7})\.\s+(\S)")
BARE = re.compile(r"(?<![^\W_])(?<!\.)[^\W\d_]{1,8}(?=[\s,;:!?)])")
INSIDE = re.compile(r"(?<=[^\W_][ ,;])\s?(?=[^\W\d_a-z])([^\W\d_]{2,})")
NAMED = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _shape(token: str) -> str:
    """A word for the corpus tables: small, without marks, digits as #, stretched letters once."""
    return re.sub(r"\d+", "#", REPEATS.sub(r"\1", token.lower())).strip(".,;:!?…\"”“'’()")


def _before(text: str, at: int) -> str:
    """The token that ends at a mark."""
    return TOKEN_BEFORE.search(text[max(0, at - 24) : at]).group()


def paragraphs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a list line) of the blocks of a text; a block holds no blank line."""
    out, start, last, in_list = [], None, 0, False
    at = 0
    for m in [*BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        line = text[at:end]
        if not line.strip():
            if start is not None:
                out.append((start, last, False))
            start, in_list = None, False
        else:
            listed = (start is None or in_list) and bool(LIST_LINE.match(line))
            if listed:
                out.append((at, end, True))
                in_list, start = True, None
            else:
                if in_list or start is None:
                    start, in_list = at, False
                last = end
        at = m.end() if m else end
    if start is not None:
        out.append((start, last, False))
    return out


def _depths(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, depth after them) of quotation marks and brackets that have a partner."""
    stack, spans = [], []
    straight = None
    for m in PAIRED.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            if straight is None:
                straight = at
            else:
                spans.append((straight, at))
                straight = None
            continue
        if stack and c in stack[-1][1]:
            spans.append((stack.pop()[0], at))
        elif c in OPEN_CLOSE:
            stack.append((at, OPEN_CLOSE[c]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if c in stack[k][1]:
                    spans.append((stack[k][0], at))
                    del stack[k:]
                    break
    events = sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans])
    if not events:
        return np.zeros(0, int), np.zeros(0, int)
    return np.array([e[0] for e in events]), np.cumsum([e[1] for e in events])


class _Both:
    """A set of all tasks and the rare entries of one document."""

    def __init__(self, common, own):
        self.common, self.own = common, own

    def __contains__(self, key) -> bool:
        return key in self.common or key in self.own

    def __bool__(self) -> bool:
        return bool(self.common or self.own)


class Evidence:
    """What a document says about its words: written small, abbreviations, names."""

    def __init__(self, text: str, opens=lambda rest: False):
        self.small = frozenset(w for w in re.findall(r"[^\W\d_]+", text) if w.islower())
        self.names = frozenset(w.lower() for w in INSIDE.findall(text))
        goes, stops = Counter(), Counter()
        for m in STOP.finditer(text):
            word = m.group(1).lower()
            stops[word] += 1
            if m.group(2) in ",;" or m.group(2).islower() and not opens(text[m.start(2) :]):
                goes[word] += 1
        bare = frozenset(w.lower() for w in BARE.findall(text)) if goes else ()
        self.short = frozenset(w for w, n in goes.items() if n >= GOES_SHARE * stops[w] and w not in bare)


class Splitter:
    """Ends of the sentences of a text, given the corpus tables."""

    def __init__(self, small: frozenset = frozenset(), short: frozenset = frozenset(), starts: frozenset = frozenset(), ends: frozenset = frozenset()):
        self.small, self.short, self.starts, self.ends = small, short, starts, ends

    def with_rare(self, keys) -> Splitter:
        """This splitter with the rare entries (kind, tab, key) of one document."""
        by = _by_kind(k.split("\t", 1) for k in keys)
        return Splitter(*(_Both(a, b) for a, b in zip((self.small, self.short, self.starts, self.ends), by, strict=True)))

    def ends_of(self, text: str, source: str | None) -> list[int]:
        if source in LYRICS:
            out, at = [], 0
            for m in [*BREAK.finditer(text), None]:
                end = m.start() if m else len(text)
                line = text[at:end]
                if line.strip():
                    out.append(at + len(line.rstrip()))
                at = m.end() if m else end
            return out
        own = Evidence(text, self._opens)
        out = []
        for a, b, listed in paragraphs(text):
            part = text[a:b]
            if listed:
                out.append(a + len(part.rstrip()))
                continue
            seen = -1
            for e in self._paragraph(part, own):
                e = len(part[:e].rstrip())
                if e > seen and part[max(seen, 0) : e].strip():
                    out.append(a + e)
                    seen = e
        return out

    def _paragraph(self, text: str, own: Evidence) -> list[int]:
        places, depth = _depths(text)

        def inside(at: int) -> bool:
            i = np.searchsorted(places, at, side="right") - 1
            return i >= 0 and depth[i] > 0

        found = set()
        for m in MARK.finditer(text):
            after = AFTER.match(text, m.end())
            end = after.end()
            if m.start() < max(found, default=0):
                continue
            # A mark right before the closing quotation mark may end the sentence with it.
            closing = text[m.end() : end].strip()
            if inside(m.start()) and (not closing or inside(end - 1) or inside(min(end, len(text)) - 1)):
                continue
            if self._ends_here(text, m, end, closing, own, inside(m.start())):
                found.add(end)
        for m in EMOJI_RUN.finditer(text):
            if m.end() < len(text) and text[m.end()].isspace() and not inside(m.start()) and re.search(r"\w", text[: m.start()]):
                found.add(m.end())
        if "฀" <= max(text, default="") and re.search("[฀-๿]", text):
            for m in THAI_END.finditer(text):
                if not inside(m.start()):
                    found.add(AFTER.match(text, m.end()).end())
        if self.ends:
            found |= self._unmarked(text, inside)
        return [*sorted(e for e in found if text[e:].strip()), len(text)]

    def _unmarked(self, text: str, inside) -> set[int]:
        tokens = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        shapes = [_shape(t[2]) for t in tokens]
        out = set()
        for i in range(2, len(tokens) - 1):
            if (shapes[i - 2], shapes[i - 1], shapes[i]) not in self.ends or inside(tokens[i][1] - 1):
                continue
            nxt = tokens[i + 1][2].lstrip("\"“«「(¡¿")
            opening = (shapes[i + 1], shapes[i + 2] if i + 2 < len(tokens) else "")
            if nxt[:1].isupper() or ((opening in self.starts or opening[:1] in self.starts) and opening != (shapes[i - 1], shapes[i])):
                out.add(tokens[i][1])
        return out

    def _ends_here(self, text: str, m: re.Match, end: int, closing: str, own: Evidence, quoted: bool) -> bool:
        mark, rest = m.group(), text[end:]
        if not rest.strip():
            return True
        nxt = NEXT_WORD.match(rest)
        word = nxt.group(1) or ""
        gap = rest[:1].isspace()
        caseless = bool(CASELESS.match(word)) if word else False
        emoji = bool(EMOJI_RUN.search(text[m.end() : end]))
        if any(c in HARD for c in mark):
            # After a closing quotation the sentence mostly goes on (who said it).
            return not quoted
        if emoji:
            return True
        before = _before(text, m.start())
        low = before.lower().strip(AROUND)
        if quoted and caseless:
            return False
        only_dots = set(mark) <= {"."} and len(mark) == 1
        if not gap:
            # A missing blank: word, mark, capitalised word.
            if not only_dots and set(mark) <= set("…") or caseless:
                return caseless and not set(mark) <= set("…") and not (only_dots and before[-1:].isdigit()) and not quoted
            if not word or not word[0].isupper():
                return self._opens(rest) and len(low) > 1 and "." not in low
            if only_dots and (len(low) < 2 or "." in low and not before[-1:].isdigit() or low in TITLES):
                return False
            return len(word) > 1 or rest[1:2].isspace()
        if set(mark) <= {"…"} and caseless:
            return False
        if caseless:
            if only_dots:
                return not (len(low) == 1 and not low.isdigit() or low in TITLES or low in own.short or low in self.short)
            return True
        if word[:1].islower():
            if only_dots and (low in TITLES or low in ABBREVIATIONS or low in own.short or len(low) == 1):
                return False
            return self._opens(rest)
        if not only_dots:
            return True
        if not word:
            return bool(rest.strip())
        if word[0].isdigit():
            return not (low in TITLES or low in ABBREVIATIONS or low in own.short or low in self.short or low.isdigit() and len(low) < 4 or len(low) == 1)
        if len(low) == 1 and low.isalpha() and before[-1:].isupper() or low in TITLES:
            return False
        if low.isdigit() and len(low) <= 2 and not self._common(word, own):
            return False
        if low in ABBREVIATIONS or low in own.short or low in self.short or "." in low and not any(c.isdigit() for c in low):
            return self._common(word, own)
        return True

    def _common(self, word: str, own: Evidence) -> bool:
        """Whether a capitalised word is no name: the document says so first, then the corpus and the list."""
        low = word.lower()
        return low in own.small or low not in own.names and (low in self.small or low in OPENERS)

    def _opens(self, rest: str) -> bool:
        opening = self._opening(rest)
        return opening in self.starts or opening[:1] in self.starts

    @staticmethod
    def _opening(rest: str) -> tuple[str, str]:
        tokens = rest.split(None, 2)
        return (_shape(tokens[0]) if tokens else "", _shape(tokens[1]) if len(tokens) > 1 else "")


def _count(frames):
    """Per batch: words written small, words before a full stop and how it goes on, openings and endings of paragraphs."""
    for frame in frames:
        counts: Counter = Counter()
        for text, source in zip(frame["text"], frame["source"], strict=True):
            if source in LYRICS:
                continue
            for w in set(re.findall(r"(?<![^\W_])[^\W\d_]{2,}", text)):
                if w.islower():
                    counts["small", w] += 1
            for m in re.finditer(r"([^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_])){0,7})\.\s+(\S)", text):
                counts["stops", m.group(1).lower()] += 1
                if m.group(2).islower() or m.group(2) in ",;":
                    counts["goes", m.group(1).lower()] += 1
            for a, b, listed in paragraphs(text):
                if listed:
                    continue
                counts["all", ""] += 1
                part = text[a:b].strip()
                tokens = part.split()
                if part[:1].islower():
                    counts["first", _shape(tokens[0])] += 1
                if part[:1].islower() and len(tokens) > 1:
                    counts["start", _shape(tokens[0]) + "\t" + _shape(tokens[1])] += 1
                if len(tokens) > 2 and re.search(r"\w$", part) and not CASELESS.search(part[-1]):
                    counts["end", "\t".join(map(_shape, tokens[-3:]))] += 1
        if counts:
            yield pd.DataFrame({"kind": [k[0] for k in counts], "key": [k[1] for k in counts], "n": list(counts.values())})


def _by_kind(pairs) -> tuple[frozenset, frozenset, frozenset, frozenset]:
    """small, short, starts and ends of (kind, key) pairs."""
    by: dict[str, set] = {"small": set(), "stops": set(), "start": set(), "first": set(), "end": set()}
    for kind, key in pairs:
        by[kind].add(key)
    starts = frozenset([*(tuple(k.split("\t")) for k in by["start"]), *((k,) for k in by["first"])])
    return frozenset(by["small"]), frozenset(by["stops"]), starts, frozenset(tuple(k.split("\t")) for k in by["end"])


def corpus_tables(documents: DataFrame) -> tuple[Splitter, DataFrame | None]:
    """The splitter with the frequent entries of this corpus, counted over all its documents, and the rare ones
    (``entry``: kind, tab, key), if any."""
    rows = spread(documents.where(F.col("text").isNotNull()).select("text", "source"))
    counts = materialize(rows.mapInPandas(_count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "sentence-counts")
    goes = counts.where("kind = 'goes'").select("key", F.col("n").alias("goes"))
    small = counts.where("kind = 'small'").select("key", F.col("n").alias("small"))
    kept = counts.where((F.col("kind").isin("small", "start", "first", "end", "stops")) & (F.col("n") >= LEAST_SEEN))
    kept = kept.join(goes, "key", "left").where((F.col("kind") != "stops") | (F.coalesce("goes", F.lit(0)) >= GOES_SHARE * F.col("n")))
    # A small word alone is an opening where a good part of the documents that write it open with it.
    kept = kept.join(small, "key", "left").where((F.col("kind") != "first") | (F.col("n") >= 0.2 * F.coalesce("small", F.lit(0))))
    size = counts.where("kind = 'all'").select("n").collect()
    size = size[0]["n"] if size else 0
    splitter = Splitter(*_by_kind((r["kind"], r["key"]) for r in kept.where(F.col("n") * RARITY >= size).select("kind", "key").collect()))
    if size <= LEAST_SEEN * RARITY:
        return splitter, None
    return splitter, materialize(kept.where(F.col("n") * RARITY < size).select(F.concat_ws("\t", "kind", "key").alias("entry")), "sentence-rare")


def _bits(entries, n_bits: int) -> np.ndarray:
    """Three places in the filter of each entry."""
    h = pd.util.hash_array(np.array(entries, dtype=object), categorize=False)
    mask = np.uint64(n_bits - 1)
    return np.stack([h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36)) & mask])


def _filter(rare: DataFrame) -> np.ndarray:
    """The filter of the rare entries, as bytes; built in pieces by the tasks."""
    n_bits = max(CHUNK, min(MOST_BITS, 1 << (FILTER_BITS * rare.count()).bit_length()))

    def places(frames):
        for frame in frames:
            at = np.unique(_bits(frame["entry"].to_numpy(), n_bits)).astype(np.int64)
            yield pd.DataFrame({"chunk": at // CHUNK, "at": at % CHUNK})

    def piece(frame):
        bits = np.zeros(CHUNK, bool)
        bits[frame["at"].to_numpy()] = True
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((n_bits // CHUNK, CHUNK // 8), np.uint8)
    for r in rare.mapInPandas(places, "chunk bigint, at bigint").groupBy("chunk").applyInPandas(piece, "chunk bigint, bits binary").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _entries(text: str, source: str | None) -> set[str]:
    """The entries a splitter may look up for a text."""
    out: set[str] = set()
    if source in LYRICS:
        return out
    out.update("small\t" + w.lower() for w in NAMED.findall(text) if not w[0].islower())
    for a, b, listed in paragraphs(text):
        if listed:
            continue
        part = text[a:b]
        shapes = [_shape(m.group()) for m in WORD.finditer(part)]
        out.update("end\t" + "\t".join(shapes[i - 2 : i + 1]) for i in range(2, len(shapes) - 1))
        out.update("first\t" + w for w in shapes)
        out.update(f"start\t{v}\t{w}" for v, w in zip(shapes, [*shapes[1:], ""], strict=True))
        for m in MARK.finditer(part):
            v, w = Splitter._opening(part[AFTER.match(part, m.end()).end() :])
            out.update((f"first\t{v}", f"start\t{v}\t{w}"))
            if m.group() == ".":
                out.add("stops\t" + _before(part, m.start()).lower().strip(AROUND))
    # Evidence reads on across paragraphs and lines.
    for m in STOP.finditer(text):
        v, w = Splitter._opening(text[m.start(2) :])
        out.update((f"first\t{v}", f"start\t{v}\t{w}"))
    return out


def _look_up(frames, shared, n_bits: int):
    """``document, entry``: entries of documents that pass the filter."""
    bits = shared.value
    for frame in frames:
        for text, source, document in frame[["text", "source", "document"]].itertuples(index=False):
            entries = list(_entries(text, source))
            if entries:
                at = _bits(entries, n_bits)
                held = (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=0)
                if held.any():
                    yield pd.DataFrame({"document": document, "entry": np.array(entries, dtype=object)[held]})


def rare_entries(documents: DataFrame, rare: DataFrame) -> DataFrame:
    """``document, rare``: the rare entries of each document that holds some."""
    bits = _filter(rare)
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    n_bits = len(bits) * 8
    asked = spread(documents.dropDuplicates(["document"])).mapInPandas(lambda it: _look_up(it, shared, n_bits), "document bigint, entry string")
    return asked.join(rare, "entry").groupBy("document").agg(F.collect_set("entry").alias("rare"))


def _split(frames, shared, texts: bool):
    splitter = shared.value
    for frame in frames:
        ids, ends, numbers, out = [], [], [], []
        for doc, text, source, rare in frame[["doc_id", "text", "source", "rare"]].itertuples(index=False):
            if not text:
                continue
            found = (splitter if rare is None else splitter.with_rare(rare)).ends_of(text, source)
            ids += [doc] * len(found)
            ends += found
            if texts:
                numbers += range(len(found))
                starts = [0, *found][: len(found)]
                out += [text[a:b].strip() for a, b in zip(starts, found, strict=True)]
        if not ends:
            continue
        if texts:
            yield pd.DataFrame({"doc_id": ids, "n": numbers, "end_char": ends, "sentence": out})
        else:
            yield pd.DataFrame({"doc_id": ids, "end_char": ends})


def sentences(documents: DataFrame, texts: bool = True) -> DataFrame:
    """``doc_id, n, end_char, sentence`` of each sentence, in order; without ``texts`` only doc_id and end_char."""
    splitter, rare = corpus_tables(documents)
    shared = documents.sparkSession.sparkContext.broadcast(splitter)
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n int, end_char int, sentence string" if texts else f"doc_id {kind}, end_char int"
    rows = documents.select("doc_id", "text", "source").where(F.col("text").isNotNull())
    if rare is None:
        rows = rows.withColumn("rare", F.lit(None).cast("array<string>"))
    else:
        rows = rows.withColumn("document", F.xxhash64("text", "source"))
        rows = rows.join(materialize(rare_entries(rows.select("text", "source", "document"), rare), "sentence-lookups"), "document", "left").drop("document")
    return spread(rows).mapInPandas(lambda it: _split(it, shared, texts), schema)
