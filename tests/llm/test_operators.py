"""Edge cases and brute-force checks of the ten operators on small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import chat_format, gif_media, html_extract, lang_id, license_scan, near_dup, packing, substring_dup, top_k, trie_bpe
from quillon.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string"


def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 90))) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [base[0]] * 6 + [base[1] + " " + base[2], "", None, "one", "one two", "\n \t", "ÀÉ ß 漢字 <|endoftext|> x", "A B\x0bC  d", "long " * 4000 + base[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None, "clash") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "a null id of some words that stand here", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates(docs, none, k, num, den):
    rows = {r.doc_id: r for r in near_dup.near_duplicates(docs, k, num, den).collect()}
    sets = {}
    for i, t in enumerate(texts()):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i in sets:
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert rows[None].component_id is None and rows[None].kept
    assert near_dup.near_duplicates(docs, k, num, den).count() == docs.count()
    assert near_dup.near_duplicates(none, k, num, den).count() == 0


def test_large_neighbourhoods_in_blocks(docs, monkeypatch):
    want = sorted(map(tuple, near_dup.near_duplicates(docs, 3, 1, 10).collect()), key=repr)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "NEIGHBOURHOOD", 2)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, near_dup.near_duplicates(docs, 3, 1, 10).collect()), key=repr) == want


def test_texts_that_share_an_id(spark):
    one, two = "a b c d e f g h i j k", "l m n o p q r s t u v"
    rows = spark.createDataFrame([(1, one), (5, one), (5, two), (9, two), (7, "z"), (7, ""), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(rows, 3, 85, 100).collect())
    assert got == [(1, 9, 1, True), (5, 9, 1, False), (5, 9, 1, False), (7, 0, 7, True), (7, 1, 7, True), (8, 0, 8, True), (9, 9, 1, False)]


def test_components_against_plain_search(spark, monkeypatch):
    from quillon.llm import graph

    monkeypatch.setattr(graph, "HUB", 3)
    rnd = random.Random(12)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(90)]
    rnd.shuffle(edges)
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def test_near_duplicates_recall_on_a_table(spark):
    """All links of op1's query against an exact join over shared shingles."""
    from quillon.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in table:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()
    of, root = {}, {i: i for i in sets}
    for i, found in sets.items():
        for x in found:
            of.setdefault(x, []).append(i)

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, found in sets.items():
        shared = {}
        for x in found:
            for j in of[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 85 * (len(found) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = queries.op1_near_dedup(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_sketch_estimates():
    rnd = np.random.Generator(np.random.PCG64(1))
    x = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2500], x[500:]
    regs = near_dup.sketch(np.repeat([0, 1, 2], [2500, 2500, 3000]), np.concatenate([a, b, x]), 3)
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    guess = near_dup.estimate((regs[:1] > regs[1:2]).sum(axis=1), (regs[:1] < regs[1:2]).sum(axis=1), np.array([2500]), np.array([2500]))[0]
    assert abs(guess - 2000 / 3000) < 0.2


def test_substring_automata_decide(docs, monkeypatch):
    every = substring_dup.without_repeats(docs, 13).agg({"n_removed": "sum"}).first()[0]
    whole = substring_dup._confirmed

    def half(size):
        return lambda table: whole(size)(table).slice(9)

    monkeypatch.setattr(substring_dup, "_confirmed", half)  # phrases that automata lack are not removed
    assert 0 < substring_dup.without_repeats(docs, 13).agg({"n_removed": "sum"}).first()[0] < every


@pytest.mark.parametrize("limit,hot,stream", [(10**6, 10**5, 10**5), (0, 10**5, 2), (10**6, 0, 3), (0, 2, 10**5)])
def test_substring_dedup(docs, none, monkeypatch, limit, hot, stream):
    monkeypatch.setattr(substring_dup, "BROADCAST_ANCHORS", limit)
    monkeypatch.setattr(substring_dup, "HOT", hot)
    monkeypatch.setattr(substring_dup, "STREAM", stream)
    monkeypatch.setattr(substring_dup, "SHARD_SEGMENTS", 40)
    rows = substring_dup.without_repeats(docs, 13)
    assert rows.columns == [*docs.columns, "n_words", "n_removed", "kept_text"] and rows.count() == docs.count()
    first = {}
    for i, t in enumerate(texts()):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for r in rows.where("doc_id is not null").collect():
        w = words(texts()[r.doc_id])
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r.doc_id:
                gone[j : j + 13] = [True] * 13
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert substring_dup.without_repeats(none).count() == 0


def test_gif_round_trip(docs, none):
    rows = gif_media.stored_features(gif_media.store_texts(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            raw = (texts()[r.doc_id] or "").encode()
            full = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert gif_media.store_texts(none).count() == 0


def test_gif_many_frames_and_general_lzw():
    payload = bytes(random.Random(3).randrange(256) for _ in range(64 * 4100))
    _, frames = gif_media.read_gif(gif_media.write_gif(payload))
    assert len(frames) == 2 and b"".join(f.pixels.tobytes() for f in frames) == payload
    # Codes of 2 bits: clear, 1, 6 (the entry being made), 6, 2, end
    codes, width, value, bits, table = [4, 1, 6, 6, 2, 5], 3, 0, 0, 6
    for k, c in enumerate(codes):
        value |= c << bits
        bits += width
        table += k > 1
        width += table == 1 << width
    assert gif_media.lzw_decode(value.to_bytes(-(-bits // 8), "little"), 2) == bytes([1, 1, 1, 1, 1, 2])


def plain_lzw(data, least_bits):
    """Bit by bit, as the format is described."""
    clear, out, table, width, last, held, bits = 1 << least_bits, b"", [], least_bits + 1, None, 0, 0
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    for byte in data:
        held, bits = held | byte << bits, bits + 8
        while bits >= width:
            code, held, bits = held & (1 << width) - 1, held >> width, bits - width
            if code == clear:
                table, width, last = table[: clear + 2], least_bits + 1, None
                continue
            if code == clear + 1:
                return out
            entry = table[code] if code != len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return out


def test_lzw_against_bit_by_bit():
    rnd = random.Random(8)
    for n in (1, 2, 300, 5000, 40_000):
        for data in (bytes(rnd.randrange(256) for _ in range(n)), bytes(rnd.choice(b"ab ") for _ in range(n)), b"a" * n):
            coded = gif_media.lzw_encode(data)
            assert gif_media.lzw_decode(coded, 8) == plain_lzw(coded, 8) == data
    assert len(gif_media.lzw_encode(b"the same words " * 1000)) < 2000
    for _ in range(30):  # any bits that name entries decode alike, also without clear codes
        bits = bytes(rnd.randrange(256) for _ in range(9000))
        try:
            want = plain_lzw(bits, 8)
        except (IndexError, TypeError):
            continue
        assert gif_media.lzw_decode(bits, 8) == want
    with pytest.raises(ValueError):
        gif_media.lzw_decode(b"\xff\xff\xff", 8)


def test_gif_frames(spark):
    payload = bytes(random.Random(6).randrange(256) for _ in range(64 * 4099))
    good = gif_media.write_gif(payload)
    cut = [good[:n] for n in (0, 3, 6, 10, 13, 40, 800, len(good) // 2, len(good) - 1)] + [b"GIF89a", b"GIF89a" + b"\xff" * 7, None]
    rows = spark.createDataFrame([(0, good), *[(i + 1, c) for i, c in enumerate(cut)]], "doc_id long, media binary")
    found = sorted(gif_media.frames_of(rows).collect(), key=lambda r: (r.doc_id, r.frame))
    mine = [r for r in found if r.doc_id == 0]
    assert [(r.frame, r.start_ms, r.delay_ms, r.width, r.height) for r in mine] == [(0, 0, 100, 64, 4096), (1, 100, 100, 64, 4096)]
    shown = np.frombuffer(mine[1].rgba, np.uint8).reshape(4096, 64, 4)
    want = np.frombuffer(payload[64 * 4096 :] + payload[64 * 3 : 64 * 4096], np.uint8).reshape(4096, 64)
    assert (shown[..., 0] == want).all() and (shown[..., 2] == want).all() and (shown[..., 3] == 255).all()
    assert mine[1].histogram == np.bincount(want.ravel() >> 5, minlength=8).tolist() * 3
    feature = gif_media.stored_features(rows.where("doc_id = 0").selectExpr("doc_id", "0L as n_bytes", "media")).first().feature
    total = [a + b for a, b in zip(mine[0].histogram, mine[1].histogram)]
    assert feature == f"frames=2;ms=200;rgb={','.join(map(str, total))}"


def test_gif_disposal_and_transparency():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    frame = lambda left, pixels, disposal, clear: gif_media.Frame(left, 0, len(pixels), 1, 50, disposal, clear, palette, np.array([pixels], np.uint8))
    shown = list(gif_media.render((3, 1), [frame(0, [1, 1, 1], 1, None), frame(1, [0, 2], 3, 0), frame(0, [3], 2, None), frame(1, [2], 0, None)]))
    colours = [[tuple(int(v) for v in p) for p in c[0]] for c in shown]
    red, green, blue, gone = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert colours == [[red, red, red], [red, red, green], [blue, red, red], [gone, green, red]]
    assert sum(gif_media.histogram(shown[3])) == 6


def test_language_held_out(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lang_id.identify(sf, lang_id.fit(sf.where(~lang_id.held_out()))).join(sf.where(lang_id.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.98 * len(found)


def test_language_edges(docs, none):
    rows = {r.doc_id: r for r in lang_id.identify(docs, lang_id.fit(docs)).collect()}
    assert [rows[i].lang_pred for i, t in enumerate(texts()) if not re.search(r"[^\W\d_]", t or "")] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in rows.values()) and lang_id.fit(none) is None
    assert {r.lang_pred for r in lang_id.identify(docs, None).collect()} == {"und"}


def test_language_rejects(spark):
    rnd = random.Random(1)
    letters = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(200))
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。", "привет", "人人", letters, base64.b64encode(rnd.randbytes(1500)).decode(),
    ]
    clean = ["Erö.", "Éaux.", "This.", "The esingor.", "Las ciónbo os."]
    sf = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    train = sf.where(~lang_id.held_out())
    odd = spark.createDataFrame([(-1, foreign[0], "fr", "", 0)], sf.schema)
    for model in (lang_id.fit(train), lang_id.fit(train.unionByName(odd))):  # one odd row sets no bound
        found = {r.doc_id: r.accepted for r in lang_id.identify(spark.createDataFrame(list(enumerate(foreign[1:] + clean)), "doc_id long, text string"), model).collect()}
        assert [found[i] for i in range(len(found))] == [False] * (len(foreign) - 1) + [True] * len(clean)
    assert lang_id.identify(sf, model).where("not accepted").count() <= 10


def test_top_k(spark):
    rnd = np.random.Generator(np.random.PCG64(4))
    vectors = [(i, [float(v) for v in rnd.normal(size=6) * (1 + i % 3)]) for i in range(450)]
    vectors += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (700, vectors[7][1]), (None, vectors[0][1]), vectors[5], (800, [1.0, 2.0]), (801, [3.0, 4.0])]
    got = {}
    for r in top_k.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(1024 * np.array(v)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 100 == 0]:
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert top_k.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_prunes_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 64)
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "HEAD", 3)
    monkeypatch.setattr(top_k, "BLOCK_BYTES", 8 * 12 * 7)
    rnd = np.random.Generator(np.random.PCG64(14))
    x = rnd.normal(size=(3000, 12)) * np.exp(rnd.normal(size=(3000, 1))) * np.linspace(2, 0.1, 12)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in top_k.top_k(rows, k=5, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 3000, 50):
        score = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    search = top_k.Search(whole[:1].astype(float), np.array([0]), np.eye(12), 5)
    taken = []
    monkeypatch.setattr(top_k.Search, "_add", lambda self, r, i, s: taken.append(len(r)))
    search.feed(whole.astype(float), np.arange(3000))
    assert sum(taken) < 1500  # bounds spare most products


def test_top_k_beyond_doubles(spark):
    big = [(0, [1e15, 3.0]), (1, [1e15 / 1024, 1.0]), (2, [1e15 / 1024, 2.0]), (3, [-1e18, 0.0]), (4, [1e18, 0.0])]
    got = [(r.rank, r.vec_id, r.score) for r in top_k.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    whole = {i: [int(np.floor(1024 * v)) for v in x] for i, x in big}
    want = {i: min(max(sum(a * b for a, b in zip(whole[0], whole[i], strict=True)), -(2**63)), 2**63 - 1) for i in (1, 2, 3, 4)}
    assert got == [(n + 1, i, want[i]) for n, i in enumerate(sorted(want, key=lambda i: (-want[i], i)))]


def test_trie_bpe(docs, none):
    tool = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for r in trie_bpe.encode_texts(docs, tokenizer("word_bpe_49k.json")).where("doc_id is not null").collect():
        ids = tool.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, tool.decode(ids, skip_special_tokens=False))
    assert trie_bpe.encode_texts(none, tokenizer("word_bpe_49k.json")).count() == 0


def test_packing(docs, none):
    tool = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=256, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in enumerate(texts()):
        if i != 3:
            ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
            found = sorted(by_doc[i], key=lambda r: r.piece)
            assert np.frombuffer(b"".join(r.ids for r in found), "<u4").tolist() == ids and all(r.length == 256 for r in found[1:])
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by_sequence) <= 1 + 1.1 * sum(r.length for r in rows) / 256 + 1
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_packing_follows_the_configurations(monkeypatch):
    rnd = random.Random(4)
    counts = {rnd.randint(1, 2047): rnd.randint(1, 500) for _ in range(600)}
    with_them = packing.plan(counts, 2048)
    seen = []
    monkeypatch.setattr(packing, "_configurations", lambda *a: seen.append(a) or [])
    assert packing.plan(counts, 2048) != with_them and len(seen) == len(packing.GROUPINGS)
    # Sequences that are not loose stay as the configurations made them.
    assert packing._repacked([(((2040, 1),), 5), (((1000, 1),), 2)], 2048, 64) == [(((2040, 1),), 5), (((1000, 2),), 1)]


def test_packing_plan_places_everything():
    rnd = random.Random(9)
    counts = {rnd.randint(1, 2047): rnd.randint(1, 500) for _ in range(400)}
    used: dict[int, int] = {}
    bins = 0
    for held, n in packing.plan(counts, 2048):
        bins += n
        assert sum(s * k for s, k in held) <= 2048
        for s, k in held:
            used[s] = used.get(s, 0) + k * n
    least = max(sum(s * n for s, n in counts.items()) / 2048, sum(n for s, n in counts.items() if s > 1024))
    assert used == counts and bins <= 1.03 * least + 1


def test_html():
    page = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><a>Menu</a></nav>
    <article><h1>Head &amp; more</h1><p>One  two<br>three <b>bold<p>Four</p><aside>Side</aside><div class="ad">Buy</div><form><input>Send</form>
    <ul><li>a<li>b</ul><script>var t="</p>";</script><section id="comments"><p>Nice!</p></section></article><footer>Foot</footer>"""
    assert html_extract.extract(page) == "Head & more\n\nOne two three bold\n\nFour\n\na\n\nb"
    assert html_extract.extract("") == "" and html_extract.extract("plain &lt;x&gt;") == "plain <x>"


def test_html_names():
    text = "<p>The main text of this page, which is longer than all the rest of it.</p>"
    for name in ("layout with-sidebar", "no-sidebar", "comments-open", "search-result", "widget", "page has-share"):
        assert html_extract.extract(f'<body><nav>Menu</nav><div class="{name}"><article><h1>T</h1>{text}</article></div></body>').startswith("T\n\nThe main"), name
        assert html_extract.extract(f'<body><nav>Menu</nav><div class="{name}">{text}</div></body>').startswith("The main"), name
    assert html_extract.extract(f"<body><form><h1>T</h1>{text}</form></body>").startswith("T\n\nThe main")
    assert html_extract.extract(f'<article><div class="entry-header"><h1>T</h1></div>{text}</article>').startswith("T\n\nThe main")
    assert "x + y" in html_extract.extract(f"<article>{text}<p>So <math><mi>x</mi> + <mi>y</mi></math></p></article>")
    assert html_extract.extract(f"<body><div>{text}</div><article><p>A teaser</p></article></body>").startswith("The main")
    for name in ("main-nav", "sidebar-left", "share-buttons", "ad", "ad-1", "cookie_banner"):
        assert html_extract.extract(f'<article>{text}<div class="{name}">Away</div></article>') == text[3:-4], name
    assert html_extract.extract(f'<article>{text}<section id="comments">{text * 3}</section></article>') == text[3:-4]


@pytest.mark.parametrize("nodes", [100_000, 0])
def test_html_style_tree(spark, monkeypatch, nodes):
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", nodes)
    one = "<body><div class=top>Same words everywhere</div><div class=text><p>Own text {0} of page {0}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", one.format(i), 1) for i in range(12)] + [(99, None, None, 1), (98, "http://h.example/x", "", 1)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got[3] == "Own text 3 of page 3" and got[99] == "" and got[98] == "" and len(got) == 14
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_style_tree_inside_articles(spark):
    one = "<body><article><h1>Title {0}</h1><p>Own text {0} of page {0}</p><p>Tell your friends</p><div class=x>Same {0} <b>Note</b> on {0}</div><p>End {0}</p></article></body>"
    copy = "<body><article><h1>A title</h1><p>A text that is copied</p></article></body>"
    rows = [(i, f"http://h.example/{i}", one.format(i)) for i in range(12)] + [(20 + i, f"http://copies.example/{i}", copy) for i in range(12)]
    rows += [(40, "http://single.example/", "<body><article>" + "<p>Again</p>" * 9 + "</article></body>")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\n\nOwn text 3 of page 3\n\nSame 3 Note on 3\n\nEnd 3"
    assert got[25] == "A title\n\nA text that is copied" and got[40] == "\n\n".join(["Again"] * 9)


def test_chat(spark):
    odd = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "hello é 漢字🙂\n"), (1, 0, "user", odd), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 1, "ro: le", "</turn>\n### user: "), (-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 3, "assistant", "a" * 5000), (None, 0, "user", "q")]
    made = chat_format.format_conversations(spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, ids string"), tokenizer("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in made.collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for role, t in turns if role == "assistant")
        assert len(got[c].ids) == len(got[c].loss_mask) and any(got[c].loss_mask) == any(t for role, t in turns if role == "assistant")
    digest = {r.conv_id: r for r in chat_format.conversation_digests(made).collect()}[-7]
    assert digest.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and digest.loss_chars == len(odd)


def test_chat_mask_decides():
    path = tokenizer("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    text = chat_format.render([("user", "é 漢字🙂 <|endoftext|>"), ("assistant", "漢字🙂 yes"), ("assistant", ""), ("assistant", "no")])
    ids = np.frombuffer(chat_format.encoder(path, special=False)(text), "<u4").astype(np.int64)
    assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids
    ends, raw = chat_format.token_ends(ids, path), text.encode()
    assert ends[-1] == len(raw)
    spans = chat_format.byte_spans(text, [(a, b) for role, _, a, b in chat_format.parse(text) if role == "assistant"])
    marks = chat_format.mask(ends, spans)
    starts = ends - np.diff(ends, prepend=0)
    assert marks.tolist() == [int(any(a < e and b > s for a, b in spans if a < b)) for s, e in zip(starts, ends, strict=True)]
    assert chat_format.under_mask(raw, ends, marks, spans) == "漢字🙂 yesno"
    wrong = marks.copy()
    wrong[np.flatnonzero(marks)[-1]] = 0
    assert chat_format.under_mask(raw, ends, wrong, spans) != "漢字🙂 yesno"
    wrong[0] = 1
    assert chat_format.under_mask(raw, ends, wrong, spans).startswith("###")


def test_licenses(spark):
    lines = ["Released under the MIT License, the mit-LICENSE.", "# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND GPL-2.0-only WITH Classpath-exception-2.0\ncode", "GNU General Public License", "license mit ümit license", None, "", "SPDX-License-Identifier: (broken OR"]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    for r in got:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), lines[r.doc_id] or ""))
        places = sorted(i for p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
    assert got[0].base_labels == "mit" and got[2].labels == "gpl" and got[6].labels == ""
    assert got[1].labels == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit"
    assert license_scan.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]


def test_license_tag_with_more_behind_it():
    cases = {
        "<!-- SPDX-License-Identifier: MIT -->": ["mit"], "SPDX-License-Identifier: MIT.": ["mit"], "/* SPDX-License-Identifier: MIT*/ int x;": ["mit"],
        "SPDX-License-Identifier: Apache-2.0 applies to this file": ["apache-2.0"], "x SPDX-License-Identifier: (MIT OR ISC) code(1)": ["isc | mit"],
        "SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0+": ["mit", "gpl-2.0+"], "SPDX-License-Identifier: MIT OR (": ["mit"],
        "SPDX-License-Identifier: (MIT OR": [], "SPDX-License-Identifier: -->": [], 'SPDX-License-Identifier: MIT"; x = 1': ["mit"],
    }
    for text, wanted in cases.items():
        assert license_scan.scan(text.encode())[7] == wanted, text


def test_license_expressions_are_linear():
    clauses = " AND ".join(f"(a{i} OR b{i})" for i in range(400))
    found = license_scan.scan(f"SPDX-License-Identifier: {clauses}".encode())
    assert len(found[5].split(",")) == 800 and found[7][0].startswith("(a0 | b0) & (a1 | b1)")
    deep = "(" * 3000 + "a" + "".join(f" OR x{i}) AND y{i}" if i % 2 else f" AND x{i}) OR y{i}" for i in range(3000))
    assert len(license_scan.licences(license_scan.evaluate(deep))) == 6001
    assert license_scan.shown(license_scan.evaluate("(c or (b or a)) and d")) == "d & (a | b | c)"
    assert license_scan.satisfied("(mit OR isc) AND gpl-2.0 WITH cp", {"isc", "gpl-2.0 with cp"}) and not license_scan.satisfied("mit AND isc", {"mit"})
    for wrong in ("a with (b or c)", "(a or b) with c", "a with b with c", "a b", "a or", ")"):
        with pytest.raises(ValueError):
            license_scan.to_postfix(wrong)
    assert license_scan.scan(b"SPDX-License-Identifier: a WITH b WITH c")[7] == ["a with b"]


def test_pipeline_language_without_ids(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(None, "1 2 3", "en", "", 5), (None, None, "en", "", None), (None, "Ing that of the and on.", "en", "", 23), (-5, "7 7", "en", "", 3), (-5, "And on the that of.", "en", "", 19)]
    left = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), "").where("doc_id is null or doc_id < 0").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(-5, "And on the that of."), (0, "Ing that of the and on.")]


def plain_components(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_pipeline(spark):
    """run() against plain versions of its stages; the language stage takes the model's verdicts text by text."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    accepted = {r.doc_id for r in lang_id.identify(docs, model).collect() if r.accepted}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id in accepted}
    sets = {}
    for i, t in left.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    component = plain_components(sets, 4, 5)
    left = {i: t for i, t in left.items() if component[i] == i}
    first = {}
    for i in sorted(left):
        w = words(left[i])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    kept = {}
    for i, t in left.items():
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        if not any(gone):
            kept[i] = t
        elif not all(gone):
            kept[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    stage = docs
    for _, run in corpus_pipeline.STAGES[:-1]:
        stage = run(spark, stage, sf)
        assert stage.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in stage.collect()} == {i: (t, len(t)) for i, t in kept.items()} and 100 < len(kept) < 200
    tool = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(kept)
    for i, t in kept.items():
        ids = np.array([*tool.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for r in pieces[i]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in pieces[i]) == len(ids)
    assert corpus_pipeline.ORACLE_SQL is None


def test_workers_give_back_what_stages_leave():
    """A worker serves stage after stage: vocabularies of one stage don't stay in the memory of the next."""
    from public_tokenizers import path

    from quillon.llm import byte_bpe, storage

    byte_bpe.encoder(path("byte_bpe_50k.json"), False)
    assert list(storage.lean(lambda batches: batches, vocabularies=True)(iter([1, 2]))) == [1, 2]
    assert byte_bpe.encoder.cache_info().currsize > 0
    assert list(storage.lean(lambda batches: batches)(iter([3]))) == [3]
    assert byte_bpe.encoder.cache_info().currsize == 0


def test_intermediate_tables_have_small_row_groups(spark):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from quillon.llm import storage

    made = storage.stored(spark.range(0, 1_500_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 512).alias("x")), "groups")
    files = [f.removeprefix("file://") for f in made.inputFiles()]
    assert made.count() == 1_500_000 and sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 3
