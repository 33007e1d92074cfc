"""Splitting, tokens, containers, fusion and spam."""

import datetime
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpworks.llm import fusion, packing, spam, splitting, tokens


# --- splitting ----------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t.", max_size=60) | st.sampled_from(["x" * 150, "ß" * 90, " " * 120]), max_size=12), st.integers(0, 20))
def test_pieces_are_whole(parts, overlap):
    data, limit = "".join(parts).encode(), 100
    pieces = splitting.split_bytes(data, limit, overlap)
    done = 0
    for i, (a, b, back, forced) in enumerate(pieces):
        assert b - a <= limit and back <= overlap and a == done - back and b > done
        data[a:b].decode()  # no character is cut
        if not forced and b < len(data):
            assert data[b - 1 : b] in (b" ", b"\t", b"\n") or data[b : b + 1] in (b" ", b"\t", b"\n")
        done = b
    assert done == len(data)
    longest = max(map(len, data.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ")))
    assert any(p[3] for p in pieces) == (longest > limit)


def test_cuts_prefer_topics():
    one, two = "cats purr and cats sleep. " * 12, "stars burn and stars glow. " * 12
    data = (one + two).encode()
    cut = splitting.split_bytes(data, 500, 0)[0][1]
    assert abs(cut - len(one)) < 30


def test_deepest_valley_of_the_window():
    """The cut lies where the topic changes, though a stronger kind of boundary and later gaps are in the window."""
    one = "the cat sat near the cat and the cat slept. the cat purred.\n\nthe cat ate. " * 5
    two = "a red star burns far from a blue star. a star may fade.\n\na star glows. " * 8
    pieces = splitting.split_bytes((one + two).encode(), 900, 0)
    assert abs(pieces[0][1] - len(one)) <= 30


def test_oversized_items(spark):
    long_, blob = "word " * 500, "y" * 2500
    hits = spark.createDataFrame([(1, long_, 0), (1, long_, 0), (2, blob, 0), (3, None, 0), (4, "", 0), (None, long_, 0), (5, "é" * 900, 0)], "hit_id long, chunk_text string, data int")
    files = spark.createDataFrame([(7, "a " * 1500, 1), (7, "a " * 1500, 1), (8, None, 1)], "file_id long, content string, body int")
    nodes = spark.createDataFrame([(1, 7, 0, 2400), (1, 7, 0, 2400), (2, 7, 100, 2000), (3, 7, 0, 3001), (4, 7, 2400, 0), (5, 7, None, 2400), (6, 8, 0, 2400), (7, 9, 0, 2400), (8, 7, -1, 2400)], "id long, file_id long, byte_start long, byte_end long")
    got = splitting.cut_kinds(splitting.split_items(splitting.oversized(hits, nodes, files)))
    assert sorted(map(tuple, got.collect())) == [("hit", 1, "clean"), ("hit", 2, "forced"), ("node", 1, "clean")]
    assert splitting.split_items(splitting.oversized(hits.limit(0), nodes.limit(0), files.limit(0))).count() == 0


# --- tokens -------------------------------------------------------------------------------------

TEXTS = ["", "hello world", "don't  stop\n\n\n now ", "naïve café 日本語 🙂", "<|endoftext|> x", "a" * 3000, " " * 5000 + "x", "x1y2 " * 40000, "\u3000\t\r\n", "word" + " " * 70000 + "end"]


def test_ids_match_another_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in TEXTS:
        ids = tokens.encode(text).tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids, text[:30]
        assert tokens.decode_bytes(ids) == text.encode()


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=400))
def test_parts_change_nothing(text):
    whole = tokens.encoding().encode_ordinary(text)
    assert [i for p in tokens.safe_parts(text, 20) for i in tokens.encoding().encode_ordinary(p)] == whole
    assert tokens.decode_bytes(whole).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab's'tre19 .,!\n\té日²_-", max_size=120), st.integers(1, 12))
def test_safe_boundaries(text, size):
    """Contractions, digits, marks and letters, cut after every few characters."""
    assert [i for p in tokens.safe_parts(text, size) for i in tokens.encoding().encode_ordinary(p)] == tokens.encoding().encode_ordinary(text)


def test_texts_without_blanks_are_cut():
    text = "abc,def1" * 40_000
    assert max(map(len, tokens.safe_parts(text))) <= tokens.LONG + 8 and tokens.decode_bytes(tokens.encode(text)).decode() == text
    blanks = " " * 1_500_000 + "x"
    assert tokens.decode_bytes(tokens.encode(blanks)).decode() == blanks


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5)], "doc_id long, text string, ids int")
    rows = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_column(df).collect())
    assert rows == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert tokens.encode_column(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in tokens.count_column(df).collect()) == [0, 0, 0, 2]


# --- containers ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_pack_keeps_capacity(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.5 * max(1, -(-sum(sizes) // 100)) + 1


def test_search_beats_first_fit():
    # First fit by decreasing size needs three containers for these, an exchange gets them into two.
    sizes = [4, 4, 5, 5, 3, 3]
    best = min(len([1]) for _ in range(1)) and 2
    assert best <= len(packing.pack(sizes, 12)) <= 3
    rng = random.Random(3)
    sizes = [rng.randint(200, 2500) for _ in range(600)]
    bins = packing.pack(sizes, 4096)
    assert sum(sizes) / (len(bins) * 4096) > 0.97


def test_fill_containers(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 900)) for i in range(300)] + [(1000, 10000), (1001, 4096), (1002, 8192), (1003, None), (1003, None), (1004, 0), (None, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n long, container string")
    got = packing.fill_containers(df, "doc_id", "n", group_items=100).collect()
    by = {}
    for r in got:
        by.setdefault(r["container"], []).append(r)
    assert all(sum(r["n_tokens"] for r in b) <= 4096 for b in by.values())
    want = {i: n or 0 for i, n in rows if i is not None}
    for item, n in want.items():
        parts = sorted((r["token_start"], r["n_tokens"]) for r in got if r["item"] == item)
        assert sum(p[1] for p in parts) == n and [p[0] for p in parts] == list(itertools.accumulate([0, *(p[1] for p in parts[:-1])]))
        assert len(parts) == max(1, -(-n // 4096))
    assert packing.fill_containers(df.limit(0), "doc_id", "n").count() == 0


# --- fusion -------------------------------------------------------------------------------------


def brute_ranking(hits, alphas):
    out = []
    for q in {h[0] for h in hits}:
        lists = {}
        for query, chunk, source, score in hits:
            if query == q and chunk is not None and source in fusion.SOURCES:
                score = None if score is None or score != score else score
                old = lists.setdefault(source, {}).get(chunk)
                lists[source][chunk] = score if old is None else old if score is None else max(old, score)
        a = alphas.get(q)
        a = 0.5 if a is None else min(1, max(0, a))
        weight = {"bm25": 1 - a, "vector": a, "hybrid": 0.5}

        def lack(chunk):
            out = []
            for s, items in lists.items():
                v = items.get(chunk)
                share = 0 if v is None else sum(x is None or x <= v for x in items.values()) / len(items)
                out.append(round(weight[s] * (1 - share), 9))
            return sorted(out + [0.0] * (3 - len(out)), reverse=True)

        chunks = sorted({c for items in lists.values() for c in items}, key=lambda c: (lack(c), c))
        out += [(q, c, i + 1) for i, c in enumerate(chunks)]
    return sorted(out)


def test_leximin_against_brute_force(spark):
    rng = random.Random(5)
    hits = [(q, f"c{rng.randint(0, 12)}", s, rng.choice([None, float("nan"), 1.0, rng.random() * scale])) for q in range(6) for s, scale in (("bm25", 50), ("vector", 1), ("hybrid", 0.03)) for _ in range(rng.randint(0, 14))]
    hits += [(1, None, "bm25", 3.0), (2, "c1", "other", 9.0)] + hits[:5]
    alphas = {0: None, 1: 0.9, 2: 0.0, 3: 1.0, 4: 7.0}
    df = spark.createDataFrame([(*h, "x") for h in hits], "query_id long, chunk_id string, source string, score float, rank string")
    cf = spark.createDataFrame([(q, a, 3) for q, a in alphas.items()] * 2, "query_id long, hybrid_alpha double, score int")
    hits = [(q, c, s, None if v is None else float(np.float32(v))) for q, c, s, v in hits]
    want = brute_ranking(hits, alphas)
    assert sorted(map(tuple, fusion.leximin_ranking(df, cf).collect())) == want
    assert sorted(map(tuple, fusion.leximin_first(df, cf).collect())) == [(q, c) for q, c, r in want if r == 1]
    assert fusion.leximin_ranking(df.limit(0), cf.limit(0)).count() == 0


def test_a_large_range_does_not_rule(spark):
    rows = [(1, "a", "bm25", 1000.0), (1, "b", "bm25", 9.0), (1, "c", "bm25", 1.0), (1, "a", "vector", 0.01), (1, "b", "vector", 0.5), (1, "c", "vector", 0.6)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, source string, score float")
    cf = spark.createDataFrame([], "query_id long, hybrid_alpha double")
    assert fusion.leximin_first(df, cf).first()["chunk_id"] == "b"


def test_search_beats_best_fit():
    """Cases in which best fit by decreasing size leaves a container too many, and exchanges empty it."""
    for seed in (306, 331, 370):
        rng = random.Random(seed)
        sizes = [rng.randint(15, 60) for _ in range(40)]
        bins = packing._Bins(100)
        for x in sorted(range(40), key=lambda i: (-sizes[i], i)):
            b = bins.best(sizes[x])
            bins.put(b if b >= 0 else bins.new(), x, sizes[x])
        got = packing.pack(sizes, 100)
        assert len(got) == len(bins.items) - 1 and sorted(x for g in got for x in g) == list(range(40)) and max(sum(sizes[x] for x in g) for g in got) <= 100


# --- spam ---------------------------------------------------------------------------------------

HONEST = {
    1: "The parser keeps a list of open files. When a file is closed, it is removed from the list, and the lock is freed.",
    2: "# Usage\n\n- [guide](https://a.example/g): This explains how the index is built.\n- [api](https://a.example/a): All the calls that you can make are here.\n",
    3: "requests==2.1.0\nnumpy==1.26.4\npandas==2.2.0\nduckdb==1.0.0\n",
    4: "```\nfree free free free free free\nbuy buy buy buy buy buy\n```\nThis is what the old code printed, and it was wrong.",
    5: "The index is an index of the index. The index is built when the index is asked for. Tags: index, search",
    6: "索引は再起動の後で読み直す。監視役が古い行を読み直す理由は何ですか。",
    7: None,
    8: "",
    9: "   \n",
}
SPAM = {
    20: "free csv reader, free csv reader online, best csv reader, free csv reader, csv reader cheap, best csv reader 2031, free csv reader, best csv reader online",
    21: "\n".join(f"https://s{i}.example/p/{i}" for i in range(20)),
    22: "We saw the lock fail, and nobody expected that.\n\n" + "cheap diff tool cheap diff tool online best diff tool cheap diff tool review " * 6,
    23: "best watch v1.2 $9.99\nbest watch v1.3 -20%\nbest watch cheap ★★★★☆\nbest watch online $5.99\nbest watch $1.00\n" * 2,
    24: "\n".join(f'<a href="https://x.example/{i}">cheap shoes</a>' for i in range(10)),
}


def test_spam_pages(spark):
    rows = [(i, t, f"https://h{i}.example/x" if i % 2 else None, None) for i, t in (HONEST | SPAM).items()]
    rows += [(20, SPAM[20], "https://h20.example/x", None), (None, SPAM[20], None, None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, url string, source string, host int")
    assert sorted(r["doc_id"] for r in spam.spam_pages(df).collect()) == sorted(SPAM)
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_writing_of_any_language_is_no_spam(spark):
    """No list of words is given: pages of languages that the corpus hardly has are judged by the shape of sentences."""
    ru = "Индекс строится один раз при запуске сервера. Затем файлы проверяются по очереди, и изменённые строки читаются снова. "
    it = "L'indice viene costruito una sola volta. Poi i file vengono letti in ordine, e le righe cambiate sono lette di nuovo. "
    zh = "索引在服务启动时只建立一次。之后系统会按顺序检查文件，并且重新读取已经改变的行。"
    rows = [(i, t * n, f"https://h{i}.example/") for i, (t, n) in enumerate([(ru, 1), (ru, 2), (it, 2), (zh, 1), (zh, 4), (ru, 30)])]
    rows += [(90, "免费下载 便宜软件 免费下载 便宜工具 免费下载 便宜软件 " * 6, "https://z.example/")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").withColumn("source", F.lit(None).cast("string"))
    assert [r["doc_id"] for r in spam.spam_pages(df).collect()] == [90]


def test_tags_and_hosts(spark):
    """Tags joined by underscores are phrases; a page of phrases that it says once is judged by the hosts that say them."""
    tags = " ".join(f"#cheap_{a}_{b}" for a in ("csv", "yaml", "log") for b in ("reader", "parser", "viewer"))
    once = ["fast row sorter", "red lamp sale", "blue chair outlet", "green desk bargain", "white shelf deals"]
    rows = [(1, tags, "https://t.example/"), (2, "; ".join(once), "https://a.example/"), (3, "; ".join(f"{p} here" for p in once), "https://b.example/")]
    rows += [(10 + i, f"{p}, {p}, {p}, {p}", f"https://h{j}.example/{i}") for i, (p, j) in enumerate(itertools.product(once, range(5)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").withColumn("source", F.lit(None).cast("string"))
    got = {r["doc_id"]: r for r in spam.spam_pages(df).collect()}
    assert 1 in got and 2 in got and 3 not in got and got[2]["by_hosts"] > 0.5 * got[2]["total"]


def test_replicated_phrases_decide(spark):
    """A list of phrases that hardly repeat in the page is spam only where other hosts carry them, too."""
    words = ["amber", "birch", "cedar", "delta", "ember", "flint", "grove", "heron"]
    phrases = [f"{a} {b} deals" for a, b in itertools.combinations(words, 2)][:24]
    rare = ", ".join(dict.fromkeys(f"{p.split()[0]}{i} {p.split()[1]}{i}x offers{i}" for i, p in enumerate(phrases)))
    alone = spark.createDataFrame([(1, rare, "https://a.example/")], "doc_id long, text string, url string").withColumn("source", F.lit(None).cast("string"))
    assert spam.spam_pages(alone).count() == 0
    many = spark.createDataFrame([(i, rare, f"https://h{i}.example/") for i in range(6)], "doc_id long, text string, url string").withColumn("source", F.lit(None).cast("string"))
    assert spam.spam_pages(many).count() == 6


def test_all_phrases_of_stuffed_lines_count(spark):
    """Other hosts carry the phrases only in the middle of lines whose words are all said again and again."""
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(60)]
    rare = "\n".join(" ".join(names[i : i + 5]) for i in range(0, 60, 5))
    stuffed = " ".join(["cheap tool sale now online", *names] * 4)
    rows = [(1, rare, "https://a.example/")] + [(10 + i, stuffed, f"https://h{i}.example/") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").withColumn("source", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in spam.spam_pages(df).collect()) == [1, 10, 11, 12, 13, 14]


def test_very_long_text():
    total, sure, possible, shingles = spam.page_evidence("cheap tool " * 100_000)
    assert sure > 0.9 * total and len(shingles) < 10
    assert isinstance(datetime.datetime.now(), datetime.datetime)
