"""Keyword-stuffed and link-list pages.

Phrases of list-like text are counted by the distinct hosts that say them, over all pages; a page is spam if most of
its characters are list-like text stitched from phrases that other hosts say, too, joined with the density of its list:
links that nothing describes, and phrases that the page itself says again and again.

1. Every page is cut into parts: lines, and the sentences and cells in them. Of each word is counted how often it stands in
   parts that have the shape of a sentence, and how often elsewhere (headings, cells, lists, tags). Words of which nearly all
   are in sentences, on most groups of hosts, are sentence words: no list of words of any language is given.
2. A part is writing if it has enough sentence words or, where the corpus knows too few of its words, the shape of a
   sentence; fenced code, code-like parts and data are writing, too. What is left is links and keyword parts.
3. Keyword parts are cut into phrases at list marks. A phrase of up to five words is a shingle; a longer run gives its
   shingles of five and of three words. (phrase, host) pairs of all pages are reduced to hosts per phrase.
4. A keyword part counts by the share of its words that lie in a shingle said on more than `min_hosts` hosts or that the
   page says `often` times or more.

Defined cases: null, empty and blank texts are not flagged; a page without a host (null url and source)
is a host of its own; repeated keys are one page per text; ties do not occur; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut

GROUPS = 8
_FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_HTML_LINK = re.compile(r"<a\s[^>]*>(.*?)(?:</a>|$)")
_MD_LINK = re.compile(r"!?\[([^\]]*)\]\((?:https?:|www\.)[^)\s]*\)?")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>|\x01\"')\]]+")
_BREAK = re.compile(r"<br\s*/?>")
_TAG = re.compile(r"<[^>]{1,200}>")
#: Where parts end within a line.
_PART_ENDS = ((". ", ".\x01"), ("! ", "!\x01"), ("? ", "?\x01"), ("。", "。\x01"), ("！", "！\x01"), ("？", "？\x01"), ("|", "\x01"))
_WORD = re.compile(r"[^\W\d_][^\W_]*")
#: Scripts that do not part words by blanks: their words are taken character by character.
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
_ENDS = ".!?。！？…।"
_HASHTAG = re.compile(r"(?<!\S)#[^\W\d]\w*")
_ODD = re.compile(r"[`=>_({};:/$€£¥%★☆-]")  # no part without such a mark is code or a shop tag
_CODE = re.compile(r"`|==|->|=>|\w_\w|\w\(|[{};]\s*$|^\s*[\w.\"-]+\s*[:=]\s*\S+\s*$|\d{4}-\d\d-\d\dt|^\s*(?://|--|\$ )|\w=\w")
_SHOP = re.compile(r"[$€£¥]\s?\d|\d\s?[€£¥]|-\d+\s?%|★|☆")
_NUMBER = re.compile(r"\d")
_LIST_MARK = re.compile(r"[,;/|>#*•·()\[\]★☆$€£¥%!?]+|\.(?:\s|$)|\s[-–—]\s|(?<!\w)v?\d[\d.]*(?!\w)")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; characters where the script has no blanks."""
    out = []
    for w in _WORD.findall(text):
        if _UNSPACED.search(w):
            out += w
        else:
            out.append(w)
    return out


def _shaped(part: str, words: list[str]) -> bool:
    """Whether a part has the shape of a sentence: five words or more, most of them different, and an end."""
    return len(words) >= 5 and part.rstrip(" \t\r\"'”’)»")[-1:] in _ENDS and 2 * len(set(words)) > len(words)


def parts(text: str):
    """Yields (kind, text, characters, words, links of its line) of each part (fence, tags, shop, code, data or words), and after each line's parts the line.

    The parts are in lower case.
    """
    text = text.lower()
    unspaced = _UNSPACED.search(text) is not None
    if "```" in text or "~~~" in text:
        for code in _FENCE.findall(text):
            yield "fence", code, len(code), [], 0
        text = _FENCE.sub("\n", text)
    for mark, ended in _PART_ENDS:
        text = text.replace(mark, ended)
    for line in text.split("\n"):
        line = line.strip(" \t\r\x01")
        size = len(line)
        if not size:
            continue
        rest, linked = line, 0
        if "<br" in line:
            rest = _BREAK.sub("\x01", rest)
        if "http" in line or "www." in line or "<a " in line:
            linked = len(_URL.findall(line)) or 1
            rest = _TAG.sub(" ", _URL.sub(" ", _MD_LINK.sub(r" \1 ", _HTML_LINK.sub(r" \1 ", rest))))
        for part in rest.split("\x01"):
            part = part.strip()
            n = len(part)
            if not n:
                continue
            if "#" in part and 2 * sum(map(len, _HASHTAG.findall(part))) > n:
                yield "tags", part, n, words_of(part.replace("_", " ")), linked
                continue
            words = words_of(part) if unspaced else _WORD.findall(part)
            odd = _ODD.search(part) is not None
            if odd and _SHOP.search(part):
                yield "shop", part, n, words, linked
            elif odd and not linked and _CODE.search(part):
                yield "code", part, n, words, linked
            elif not words or (2 * sum(map(len, words)) < n and len(_NUMBER.findall(part)) * 2 > n):
                yield "data", part, n, words, linked
            else:
                yield "words", part, n, words, linked
        yield "line", "", size, [], linked


def sentence_counts(texts) -> dict[int, list[int]]:
    """Hash of each word -> [in parts shaped as sentences, in all parts of words, pages]."""
    inside, every, pages = Counter(), Counter(), Counter()
    for text in texts:
        mine = []
        for kind, part, _, words, _ in parts(text or ""):
            if kind == "words" and _shaped(part, words):
                inside.update(words)
                mine += words
            elif kind in ("words", "tags", "shop"):
                every.update(words)
                mine += words
        pages.update(set(mine))
    return {_hash(w): [inside[w], inside[w] + every[w], n] for w, n in pages.items()}


_ENTRIES = ",;/>•·、，；"


def _listed(part: str, words: list[str]) -> bool:
    """Whether a part is a list by its marks: six or more short entries, half of whose words come again."""
    if len(words) < 6:
        return False
    entries = sum(map(part.count, _ENTRIES)) + 1
    return entries >= 6 and len(words) <= 4 * entries and 2 * len(set(words)) <= len(words) + entries


class Lexicon(dict):
    """The common words of a corpus: 1 for those of sentences, 0 for the others, -1 for words that are not common."""

    def __init__(self, sentence: set[int], other: set[int]):
        self.sentence, self.other = sentence, other

    def __missing__(self, word: str) -> int:
        h = _hash(word)
        kind = 1 if h in self.sentence else 0 if h in self.other else -1
        if len(self) < 1 << 20:  # a memory of what was looked up
            self[word] = kind
        return kind

    def __reduce__(self):
        return Lexicon, (self.sentence, self.other)

    def is_writing(self, part: str, words: list[str]) -> bool:
        if _listed(part, words):
            return False
        kinds = list(map(self.__getitem__, words))
        good, rare = kinds.count(1), kinds.count(-1)
        if 2 * rare < len(kinds):
            return 3 * good >= len(kinds) and len({w for w, k in zip(words, kinds) if k == 1}) >= 2
        return _shaped(part, words)


def page_evidence(text: str | None, lexicon: Lexicon = Lexicon(set(), set()), often: int = 3, width: int = 5, short: int = 3) -> tuple[int, float, float, dict[tuple[int, ...], list[float]]]:
    """(characters, sure, possible, what words add by the shingles that they lie in).

    sure are the characters of bare links and of what the page repeats, possible those of all links and keyword parts. A
    word's value is [characters, those of them that are not sure]; it counts if one of its shingles is replicated.
    """
    if not text or not text.strip():
        return 0, 0.0, 0.0, {}
    total = links = prose = named = told = 0
    found: list[tuple[int, list[list[str]]]] = []
    for kind, part, n, words, linked in parts(text):
        if kind == "fence":
            total += n
        elif kind == "line":
            total += n
            # A sentence describes one link of its line; the others are bare, with their share of the line.
            links += (n - named - prose) * max(0, linked - told) / linked if linked else 0
            prose = named = told = 0
        elif kind == "code" or (kind == "words" and lexicon.is_writing(part, words)):
            prose += n
            told += 1
        elif kind != "data":
            named += n
            found.append((n, [p for p in (words_of(x.replace("_", " ")) for x in _LIST_MARK.split(part)) if p]))
    if not found:
        return total, float(links), float(links), {}
    said = Counter(w for _, phrases in found for p in phrases for w in p)
    sure, possible, adds = float(links), float(links), {}
    for n, phrases in found:
        per = n / max(1, sum(len(w) for p in phrases for w in p))
        possible += n
        for p in phrases:
            mine: list[list[int]] = [[] for _ in p]
            for k in (width, short) if len(p) > width else (len(p),):
                for i in range(len(p) - k + 1):
                    h = _hash(" ".join(p[i : i + k]))
                    for j in range(i, i + k):
                        mine[j].append(h)
            for w, own in zip(p, mine):
                v = adds.setdefault(tuple(sorted(set(own))), [0.0, 0.0])
                v[0] += per * len(w)
                if said[w] >= often:
                    sure += per * len(w)
                else:
                    v[1] += per * len(w)
    return total, sure, possible, adds


def lexicon_of(pages: DataFrame, common: float = 1e-4, least: int = 3, share: float = 0.9) -> Lexicon:
    """The words of at least `least` pages and one in 1 / common, from all pages.

    A word is one of sentences if that holds for `share` of its uses in most of the groups of hosts that say it, so one
    host, however large, decides in one group only. There are at most (words per page) / common such words.
    """

    def run(batches):
        for pdf in batches:
            for g, texts in pdf.groupby("g")["text"]:
                c = sentence_counts(texts)
                yield pd.DataFrame({"w": np.fromiter(c, np.int64, len(c)), "g": int(g), "s": [v[0] for v in c.values()], "n": [v[1] for v in c.values()], "p": [v[2] for v in c.values()]})

    grouped = pages.select("text", F.pmod(F.xxhash64("host"), F.lit(GROUPS)).cast("int").alias("g"))
    counts = grouped.mapInPandas(run, "w long, g int, s long, n long, p long")
    in_group = lambda c, g: F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0))
    sums = counts.groupBy("w").agg(F.sum("p").alias("pages"), *(in_group(c, g).alias(f"{c}{g}") for c in "sn" for g in range(GROUPS)))
    has = sum((F.col(f"n{g}") > 0).cast("int") for g in range(GROUPS))
    good = sum(((F.col(f"n{g}") > 0) & (F.col(f"s{g}") >= share * F.col(f"n{g}"))).cast("int") for g in range(GROUPS))
    least = max(least, int(common * pages.count()))
    rows = sums.filter(F.col("pages") >= least).select("w", (2 * good > has).alias("sentence")).toPandas()
    return Lexicon(set(rows.loc[rows["sentence"], "w"].tolist()), set(rows.loc[~rows["sentence"], "w"].tolist()))


def spam_pages(docs: DataFrame, min_hosts: int = 3, share: float = 0.5, often: int = 3) -> DataFrame:
    """`doc_id, total, spam, by_hosts`: the flagged pages, how many of their characters are evidence, and how many of them are phrases of other hosts."""
    spark = docs.sparkSession
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)), F.lit("")), F.col("source"), F.concat(F.lit("doc:"), F.col("doc_id")))
    pages = docs.select("doc_id", host.alias("host"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    shared = spark.sparkContext.broadcast(lexicon_of(pages))

    def run(batches):
        for pdf in batches:
            out = []
            for d, h, t in zip(pdf["doc_id"], pdf["host"], pdf["text"]):
                total, sure, possible, adds = page_evidence(t, shared.value, often)
                phrases = list({s for own in adds for s in own})
                ask = possible > share * total  # only pages that could be flagged ask; all pages tell what they say
                out.append((d, h, total, sure, ask, phrases, [list(k) for k in adds] if ask else [], [v[0] for v in adds.values()] if ask else [], [v[1] for v in adds.values()] if ask else []))
            yield pd.DataFrame(out, columns=["doc_id", "host", "total", "sure", "ask", "phrases", "lies_in", "chars", "unsure"])

    schema = "doc_id long, host string, total long, sure double, ask boolean, phrases array<long>, lies_in array<array<long>>, chars array<double>, unsure array<double>"
    seen = cut(pages.mapInPandas(run, schema))
    # Distinct hosts of each phrase, over all pages: one row per phrase and host leaves the map side.
    on_hosts = seen.select(F.xxhash64("host").alias("host"), F.explode("phrases").alias("p")).groupBy("p", "host").agg(F.lit(1).alias("one"))
    spread = on_hosts.groupBy("p").agg(F.count("one").alias("hosts")).filter(F.col("hosts") > min_hosts).select(F.col("p").alias("spread_p"))
    open_ = seen.filter("ask")
    asked = open_.select("doc_id", F.explode("phrases").alias("p"))
    known = salted_join(asked, spread, "p", "spread_p", spread_by="doc_id", how="inner").groupBy(F.col("doc_id").alias("k_id")).agg(F.collect_set("p").alias("known"))
    joined = open_.drop("phrases", "host").join(known, F.col("doc_id") == F.col("k_id"), "left")
    at = F.arrays_zip("lies_in", "chars", "unsure")
    replicated = F.filter(at, lambda x: F.arrays_overlap(x["lies_in"], F.coalesce("known", F.array().cast("array<bigint>"))))
    add = lambda field: F.aggregate(replicated, F.lit(0.0), lambda acc, x: acc + x[field])
    judged = joined.select("doc_id", "total", (F.col("sure") + add("unsure")).alias("spam"), add("chars").alias("by_hosts"))
    return judged.filter(F.col("spam") > share * F.col("total")).dropDuplicates(["doc_id"])
