"""The methods themselves: independent decoders and extractors, retrieval against brute force, models on held-out samples, odd input."""

import hashlib
import html
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from strandloom.llm import bpe, decontam, html_text, jpeg, langid, pfp, queries, secrets, simhash, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
STORY = "<p>" + "A sentence of the story, with words enough. " * 4 + "</p>"


def naive_text(page):
    """The article element of a page that has one: markup cut out by regular expressions."""
    body = re.search(r"(?s)<article[^>]*>(.*?)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style).*?</\1>", "", page))[1]
    parts = re.sub(r"</?(?:p|h\d|div|ul|ol|li|section|blockquote|table|tr|td)\b[^>]*>", "\0", re.sub(r"<br[^>]*>", " ", body)).split("\0")
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)


def test_pages_equal_a_naive_extractor(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert len(pages) > 20
    for page in pages:
        assert html_text.extract(page) == naive_text(page)
        unscoped = re.sub(r"(</?)article", r"\1div", page)  # no article element: density alone
        assert html_text.extract(unscoped).split("\n")[-1] == naive_text(page).split("\n")[-1]


def test_density_decides():
    assert html_text.extract(f"<body><div><a href='/'>Home</a></div><div class='elementor-widget-text'>{STORY * 4}</div><div><a href='/x'>one</a> short tail</div></body>").count("of the story") == 16
    text = html_text.extract(f"<body><article>{STORY}<p class='side-by-side'>Both sides of it.</p><div class='side-by-side'><p>Column one</p></div>{STORY}</article></body>")
    assert "Both sides of it.\nColumn one" in text
    links = "<li><a href='/x'>Link of a menu</a></li>" * 30
    assert html_text.extract(f"<body><main><ul>{links}</ul><h1>Title</h1>{STORY * 3}</main></body>").startswith("Title\nA sentence")
    comments = "<div class='comments'>" + "<div class='comment'><p>I liked this one a lot, it was good.</p></div>" * 6 + "</div>"
    assert "liked" not in html_text.extract(f"<body><div id='content'><h1>Title</h1>{STORY * 5}{comments}</div></body>")
    assert html_text.extract(f"<body><form>{STORY * 3}<input><select><option>x</select></form></body>").count("of the story") == 12
    assert html_text.extract("<body><h1>Title</h1><div>" + STORY * 3 + "</div></body>").startswith("Title\n")
    assert html_text.density(100, 0, 0, 0, 0.0) == pytest.approx(100 * math.log(100) / math.log(math.log(1 + math.e)))


def test_long_and_broken_pages():
    began = time.time()
    for piece, text in (("<div>", ""), ("<b>", ""), ("<p>x", "x\n" * 40_000), ("<", "<" * 40_000), ("<a ", ""), ("<p class='", "")):
        assert html_text.extract(piece * 40_000).strip() == text.strip()
    assert html_text.extract("<b>" * 20_000 + "</i>" * 20_000 + "end") == "end"
    assert time.time() - began < 60


class Bits:
    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, codes):
        word = ""
        while word not in codes:
            word += self.bits[self.at]
            self.at += 1
        return codes[word]


def naive_dc(media):
    """Luminance DC values of the first image of one component, bit by bit, and where it ends."""
    at, tables, quantum, every = 2, {}, None, 0
    while True:
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        part = media[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quantum = part[1]
        elif marker == 0xC0:
            height, width = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
        elif marker == 0xDD:
            every = int.from_bytes(part, "big")
        elif marker == 0xC4:
            k = 0
            while k < len(part):
                counts, code, words = part[k + 1 : k + 17], 0, {}
                values = iter(part[k + 17 : k + 17 + sum(counts)])
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        words[f"{code:0{n}b}"] = next(values)
                        code += 1
                    code <<= 1
                tables[part[k]] = words
                k += 17 + sum(counts)
        at += 2 + size
        if marker == 0xDA:
            break
    end = media.index(b"\xff\xd9", at)
    out, n = [], (height // 8) * (width // 8)
    for segment in re.split(rb"\xff[\xd0-\xd7]", media[at:end]):
        bits, last = Bits(segment.replace(b"\xff\x00", b"\xff")), 0
        for _ in range(min(every or n, n - len(out))):
            size = bits.symbol(tables[0])
            v = bits.take(size) if size else 0
            last += v if not size or v >> (size - 1) else v - (1 << size) + 1
            k = 1
            while k < 64:
                run = bits.symbol(tables[16])
                if run == 0:
                    break
                k += 1 + (run >> 4)
                bits.take(run & 15)
            out.append(max(0, min(255, round(last * quantum / 8) + 128)))
    return bytes(out), end + 2, (width, height)


def test_jpeg_columns_by_an_independent_decoder(spark):
    texts = ["", None, "x" * 64, "The quick brown fox; ümläut 😀 " * 9, "".join(map(chr, range(1, 256))) * 2, "a" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in jpeg.store_and_read(docs).collect():
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = jpeg.write(padded)
        back, end, (width, height) = naive_dc(media)
        assert back == padded and end == len(media)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        rows = [[padded[64 * y + x] for x in range(64)] for y in range(len(padded) // 64)]
        cells = []
        for i in range(8):
            for j in range(8):
                top, bottom = i * len(rows) // 8, max((i + 1) * len(rows) // 8, i * len(rows) // 8 + 1)
                cell = [rows[y][x] for y in range(top, bottom) for x in range(8 * j, 8 * j + 8)]
                cells.append(sum(cell) * 64 // len(cell))
        mean = sum(cells) / 64
        bits = "".join("1" if c > mean else "0" for c in cells)
        assert r.feature == f"{width}x{height}:{int(bits, 2):016x}"


def test_wand_finds_all_above_the_threshold(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    items += [(None, " ".join(t for _, t in items[:12])), (9_999, " ".join(t for _, t in items[5:60]))]
    index = decontam.BlockMaxIndex(items)
    assert [c.step for c in index.classes][0] == 48 and len(index.classes) > 2
    rnd = random.Random(7)
    for own in index.classes:
        for _ in range(40):
            terms = sorted({index.terms[w] for i in range(rnd.randint(1, 3)) for w in decontam.words(rnd.choice(items)[1])})
            scores = {}
            for t in terms:
                for i in range(*own.at[t]):
                    scores.setdefault(own.items[i], []).append(own.weights[i])
            for threshold in (0.1, 0.3, 0.5, 0.9):
                want = {k: math.fsum(v) for k, v in scores.items() if math.fsum(v) >= threshold}
                assert dict(own.retrieve(terms, threshold)) == want
                assert not want or own.worth(np.zeros(len(terms), np.int64), np.array(terms), threshold - 1e-9).tolist() == [0]
    docs = [(1, "Before it. " * 50 + items[-1][1] + " after it." * 50), (2, items[-2][1]), (3, items[3][1])]
    found = {(d, i) for d, t in docs for i, *_ in index.matches(t, 0.5, 0.8)}
    assert (1, 9_999) in found and (2, None) in found and (3, items[3][0]) in found


def test_random_and_ordinary_tokens_apart(spark):
    rnd = random.Random(11)
    signs = secrets.ALPHABET[:62]
    random_tokens = ["".join(rnd.choice(signs) for _ in range(rnd.randint(24, 48))) for _ in range(400)]
    random_tokens = [t for t in random_tokens if re.search("[0-9]", t) and not re.search("[0-9a-f]{16}", t)]
    words = "alpha river window garden yellow market silver doctor engine travel morning picture kitchen problem teacher".split()
    plain = [rnd.choice("_-/").join(rnd.choice(words) for _ in range(4)) + f"_{rnd.randint(1, 2030)}" for _ in range(400)]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(random_tokens + plain)], "doc_id long, text string")
    table = secrets.train(secrets.labelled_samples(spark))
    hits = {r.doc_id for r in secrets.report(secrets.scan(docs, table)).where("n_random > 0").collect()}
    true = len([i for i in hits if i < len(random_tokens)])
    assert true / len(random_tokens) >= 0.95 and true / len(hits) >= 0.95


def test_secrets_leaves_columns_of_clashing_names(spark):
    table = secrets.train(secrets.labelled_samples(spark))
    rnd = random.Random(3)
    long = "".join(rnd.choice(secrets.ALPHABET[:62]) for _ in range(200_000))
    docs = spark.createDataFrame([(1, "secret=abcdefghijklmnop", "u", 7, "v"), (2, None, None, None, "w"), (3, f"a {long} b", "x", 1, "y")], "doc_id long, text string, base string, Added long, base_ string").cache()
    docs.count()
    began = time.time()
    got = {r.doc_id: r for r in secrets.redact(docs, table).collect()}
    assert time.time() - began < 30
    assert tuple(got[1]) == (1, "[SECRET]", "u", 7, "v") and tuple(got[2]) == (2, None, None, None, "w") and tuple(got[3]) == (3, "a [SECRET] b", "x", 1, "y")


def test_links_and_components_of_rows_without_ids(spark):
    base = simhash.fingerprint("one two three four five six")
    rows = [(1, "one two three four five six"), (None, "ONE two  three four five six"), (None, "some other words in a row here"), (5, "")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (None, 1), (None, None), (5, 5)}
    fps = [base ^ x for x in (0, 1, 1 << 40 | 3, (1 << 63) | (1 << 5) | (1 << 33) | 1, 31, 63)]
    nodes = spark.createDataFrame([(f - (f >> 63 << 64), i) for i, f in enumerate(fps)], "fp long, node long")
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if (fps[i] ^ fps[j]).bit_count() <= 4}
    for dense in (simhash.DENSE, 0):
        simhash_scheme, simhash.DENSE = simhash.DENSE, dense
        try:
            assert {(r.a, r.b) for r in simhash.links(nodes).collect()} == want
        finally:
            simhash.DENSE = simhash_scheme


def test_hashes_tell_thue_morse_strings_apart():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba"))).encode(), np.uint8)
    hashed, n = pfp.Hashed(data), len(word)
    starts = np.array([0, n])
    assert len(set(hashed(starts, starts + n, 1).tolist())) == 2
    again = pfp.Hashed(np.concatenate((data, data)))
    assert again(starts, starts + n, 1).tolist() == again(starts + 2 * n, starts + 3 * n, 1).tolist() == hashed(starts, starts + n, 1).tolist()


def test_repeats_in_one_long_text(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abcdefgh \n") for _ in range(900))
    text = "".join(rnd.choice("abcdefgh \n") for _ in range(300_000)) + part + "x" + "".join(rnd.choice("abcdefgh") for _ in range(5000)) + part
    docs = spark.createDataFrame([(1, text), (1, text[:50_000] + "other"), (None, part), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in substring_dedup.dedup_digests(docs).collect()}
    assert got == {(1, len(text)): (50_000 + 1800, 3), (1, 50_005): (50_000, 1), (None, 900): (900, 1), (2, 0): (0, 0)}


def test_models_on_repeated_and_long_texts(spark):
    docs = [(i, f"you are an idiot {i % 3}", "en", 1) for i in range(40)] + [(100 + i, f"a calm walk by the river {i % 4}", "en", 0) for i in range(40)] + [(200 + i, "", "en", 0) for i in range(5)] + [(300, None, "de", 1)]
    documents = spark.createDataFrame(docs * 3, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(documents, documents.select("doc_id", "toxic"))
    long = "a calm walk by the river. " * 20_000
    assert model.score(long) < 0.3 <= model.score(long + "you are an idiot!") and model.score("") == model.score(None) < 0.3
    words = {"en": "the and with this that from over", "de": "der und mit das aus über nicht"}
    texts = [(i + 1000 * (lang == "de"), " ".join(random.Random(i).choices(words[lang].split(), k=30)), lang) for lang in words for i in range(60)] * 2
    known = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert known.score([("the and with this that " * 40_000), ("der und mit das nicht " * 40_000)])[0] == ["en", "de"]


def test_tables_of_the_encoder_are_bounded(monkeypatch):
    from strandloom.llm.queries import ranks_path

    own = bpe.codec(ranks_path())
    monkeypatch.setattr(bpe, "MAX_PIECES", 100)
    own.pieces.clear()
    rnd = random.Random(4)
    for _ in range(400):
        own.encode("".join(rnd.choice("abcdefgh") for _ in range(9)))
    long = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    assert len(own.encode(long)) > 0 and long not in own.pieces and len(own.pieces) <= 100
    assert len(own.pieces.transducer.made) <= bpe.MAX_STATES


def test_short_pieces_make_no_states_beyond_a_full_table(monkeypatch):
    rnd = random.Random(5)
    ranks = bpe.read_ranks(queries.ranks_path())
    own = bpe.MergeTransducer(ranks, max_states=300)
    parts = ["ch", "keit", "ung", "é", "sch", "ein", "zu", "q", "7", "-", "中"]
    pieces = [" " + "".join(rnd.choices(parts, k=rnd.randrange(1, 9))) for _ in range(2000)]
    for piece in pieces[:1000]:
        own.encode(piece.encode())
    assert len(own.made) >= 300
    steps, step = [], own.step
    monkeypatch.setattr(own, "step", lambda *x: steps.append(x) or step(*x))
    for piece in pieces:
        assert own.encode(piece.encode()) == bpe.merge_pairs(piece.encode(), ranks)
    assert not steps
    long = "".join(rnd.choices(parts, k=2 * bpe.SHORT)).encode()
    assert own.encode(long) == bpe.merge_pairs(long, ranks) and steps


def test_entries_come_out_of_the_transducer(monkeypatch):
    """Every entry of the public table is its own encoding, so none is looked up; entries that merging does not lead to are found, and stay one token."""
    import tiktoken

    ranks = bpe.read_ranks(queries.ranks_path())
    assert bpe.exceptions_of(queries.ranks_path()) == frozenset()
    own = bpe.MergeTransducer(ranks, exceptions=frozenset())
    rnd = random.Random(8)
    assert all(own.encode(t) == [ranks[t]] for t in rnd.sample(sorted(ranks), 3000))
    odd = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"bcd": 259, b"zzzz": 260, b"abcd": 261}
    assert bpe.not_their_own_encoding(odd) == {b"bcd", b"zzzz"} - {t for t in (b"bcd", b"zzzz") if bpe.merge_pairs(t, odd) == [odd[t]]}
    machine, theirs = bpe.MergeTransducer(odd), tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=odd, special_tokens={})
    for n in range(1, 7):
        for _ in range(60):
            word = "".join(rnd.choices("abcdz", k=n))
            assert machine.encode(word.encode()) == theirs.encode(word), word


def test_learned_terms_take_little_memory():
    import tracemalloc

    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=9)) for _ in range(60_000)]
    rows = [(" ".join(rnd.choices(words, k=300)) + (" grumblewort" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(2000)]
    tracemalloc.start()
    insults, _ = toxicity.learn_terms(rows, set())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "grumblewort" in insults and peak < 60e6
