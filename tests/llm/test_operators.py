"""Operators against brute force, round trips and held-out accuracy; edge cases of each."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from zephyrlake.llm import chat, licenses, line_dedup, media, near_dedup, pieces, queries, shards, toxicity, url_graph
from zephyrlake.llm.decontaminate import Decontamination, find_items

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, version int, pos int, h long"


def docs(spark, texts, start=0):
    """Documents with columns whose names clash with those that operators use inside."""
    rows = [(k, t, "en", 1, 2, 3) for k, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOCS)


def vocabulary(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(seed, n, words=400):
    v, rng = vocabulary(1, words), random.Random(seed)
    return " ".join(rng.choice(v) for _ in range(n))


ODD = [None, "", "   ", "\n\n", "word", "two words", "ÀÉÎ ﬀ 日本 😀 \x00 ▁ <s> \\ < >", "x" * 70_000, " ".join(["again"] * 9000)]


# --- 1: media ---


def test_media_round_trip_and_faults():
    rng = random.Random(0)
    for n in (0, 1, 575, 576, 577, 576 * 33, 50_001):
        payload = media.pad(rng.randbytes(n))
        stream = media.write_stream(payload)
        s = media.read_stream(stream)
        assert len(payload) % 576 == 0 and len(stream) % 188 == 0 and s.payload[media.ES_PID] == payload
        assert s.programs == {1: media.PMT_PID} and s.streams == {media.ES_PID: 6} and not (s.jumps or s.lost_sync or s.bad_sections)
        assert [u[1] for u in s.units] == [
            k * media.TICKS
            for k in range(len(payload) // 576)
        ] and [k for k, u in enumerate(s.units) if u[4]] == list(range(0, len(s.units), 16))
    lost = stream[: 188 * 9] + stream[188 * 10 :]
    assert media.read_stream(lost).jumps == 1
    twice = stream[: 188 * 9] + stream[188 * 8 : 188 * 9] + stream[188 * 9 :]
    assert media.read_stream(twice).repeats == 1 and media.read_stream(twice).payload == s.payload
    assert media.read_stream(b"\x00" * 77 + stream).lost_sync == 1 and media.read_stream(b"\x00" * 77 + stream).payload == s.payload
    broken = bytearray(stream)
    broken[12] ^= 1
    assert media.read_stream(bytes(broken)).bad_sections == 1
    for bad in (None, b"", b"\x47" * 1000, rng.randbytes(5000)):
        media.read_stream(bad)
    short = media.read_stream(lost)
    assert [k for k, u in enumerate(short.units) if u[5]] == [next(k for k, u in enumerate(short.units) if u[3] < 576)] and not any(u[5] for u in s.units)
    apart = stream[: 188 * 3] + stream[: 188 * 2] + stream[188 * 2 : 188 * 3] + stream[188 * 3 :]  # a repeat after packets of other streams
    assert media.read_stream(apart).repeats == 3 and media.read_stream(apart).payload == s.payload
    marked = bytearray(stream)
    marked[188 * 9 + 1] |= 0x80
    assert (media.read_stream(bytes(marked)).errors, media.read_stream(bytes(marked)).jumps) == (1, 1)


def plain_demux(stream):
    """The elementary stream's payload by the letter of the packet headers, without any other checks."""
    out, pes = b"", b""
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        assert p[0] == 0x47
        if (p[1] & 0x1F) << 8 | p[2] == 0x100:
            body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
            if p[1] & 0x40:
                out, pes = out + pes[14:], b""
            pes += body
    return out + pes[14:]


def ts_packets(pid, body, first=0, start=True):
    """Packets that hold body, the last one with an adaptation field as stuffing."""
    out, k = [], first
    while body:
        part, body = body[:184], body[184:]
        gap = 184 - len(part)
        head = bytes([0x47, (0x40 if start and k == first else 0) | pid >> 8, pid & 255, (0x30 if gap else 0x10) | k & 15])
        out.append(head + (bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"") if gap else b"") + part)
        k += 1
    return out


def test_media_tables_over_several_packets():
    pat = media._section(0, 1, b"\x00\x01" + (0xE000 | 0x100).to_bytes(2, "big") + b"\x00\x02" + (0xE000 | 0x101).to_bytes(2, "big"))
    streams = {0x200 + k: 6 + k % 3 for k in range(70)}
    pmt = lambda some, number: media._section(
        2, number, b"\xff\xff\xf0\x00" + b"".join(bytes([kind]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for p, kind in some.items())
    )
    one, two = dict(list(streams.items())[:60]), dict(list(streams.items())[60:])
    unit = lambda k: ts_packets(0x200 + k, media._pes(k, bytes([k]) * 300))
    tables = ts_packets(0, b"\x00" + pat) + ts_packets(0x100, b"\x00" + pmt(one, 1)) + ts_packets(0x101, b"\x00" + pmt(two, 2) + pmt({0x900: 9}, 2))
    assert len(tables) >= 4
    data = unit(0) + unit(69) + ts_packets(0x300, media._pes(1, b"unnamed"))
    for packets in (tables + data, data + tables, tables[:2] + data[:2] + tables[2:] + data[2:]):  # wherever the tables are
        s = media.read_stream(b"".join(packets))
        assert s.programs == {1: 0x100, 2: 0x101} and s.streams == streams | {0x900: 9} and s.bad_sections == 0
        assert s.payload == {0x200: b"\x00" * 300, 0x245: bytes([69]) * 300} and [u[0] for u in s.units] == [0x200, 0x245]
    assert media.read_stream(b"".join(tables[:2] + tables[3:])).bad_sections >= 1  # a lost part
    later = bytearray(pmt(two, 2)[:-4])
    later[5] &= 0xFE
    later += media.crc_mpeg(bytes(later)).to_bytes(4, "big")
    assert media.read_stream(b"".join(ts_packets(0, b"\x00" + pat) + ts_packets(0x101, b"\x00" + bytes(later)))).streams == {}
    whole = media.read_stream(b"".join(ts_packets(0, b"\x00" + pat) + ts_packets(0x101, b"\x00" + pmt({0x200: 6}, 2)) + unit(0)[:1]))
    assert [(u[3], u[5]) for u in whole.units] == [(170, True)]


def test_media_columns(spark):
    df = docs(spark, ODD)
    rows = {r.doc_id: r for r in media.index(media.store(df)).collect()}
    for k, t in enumerate(ODD):
        assert media.read_stream(rows[k].media).payload[media.ES_PID] == media.pad((t or "").encode())
        assert rows[k].media_index.programs == {1: media.PMT_PID} and not any(u.damaged for u in rows[k].media_index.units)
        assert len(rows[k].media_index.units) == max(1, -(-len((t or "").encode()) // 576))
    assert media.store(df.limit(0)).count() == 0


# --- 2: licenses ---


def test_licenses(spark):
    noise = prose(3, 300).split()
    full = licenses.TEMPLATES["GPL-3.0-header"]
    cut = " ".join(w for k, w in enumerate(full.split()) if k % 6)  # five of six words
    half = " ".join(full.split()[::2])
    texts = [
        *ODD, " ".join([*noise, full, *noise]), " ".join([*noise, cut]), " ".join([*noise, half]), "RELEASED   under\nthe MIT license.",
        " ".join(noise), licenses.TEMPLATES["MIT"] + " " + " ".join(noise) + " " + licenses.TEMPLATES["MIT"]
    ]
    found = defaultdict(list)
    for r in licenses.find_licenses(docs(spark, texts)).collect():
        found[r.doc_id].append((r.license_id, round(r.coverage, 2), r.first_word))
    n = len(ODD)
    assert found[n] == [("GPL-3.0-header", 1.0, 300)] and [x[0] for x in found[n + 1]] == ["GPL-3.0-header"] and 0.8 <= found[n + 1][0][1] < 0.9
    assert not found[n + 2] and found[n + 3] == [("MIT", 1.0, 0)] and not found[n + 4] and len(found[n + 5]) == 2
    assert all(not found[k] for k in range(n))


def test_licenses_side_by_side():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.8).scan
    for name in ("MIT", "CC-BY-4.0", "MIT-permission", "BSD-3-Clause"):
        notice = licenses.TEMPLATES[name].split()
        for gap in range(1, 21):
            for damage in (0, 1):
                some = notice[:2] + notice[3:] if damage and len(notice) > 5 else notice
                text = [*prose(1, 9).split(), *some, *prose(2, gap).split(), *notice, *prose(3, gap).split(), *some, *prose(4, 9).split()]
                n, m = len(licenses.words(" ".join(some))), len(licenses.words(" ".join(notice)))
                at = [(9, n), (9 + n + gap, m), (9 + n + gap + m + gap, n)]
                assert [(f, k) for x, _, k, f, _, _ in scan(" ".join(text)) if x == name] == at, (name, gap, damage)
    text = "foo bar Released under the MIT License baz Released under the MIT License qux"
    assert [h[:1] + h[3:5] for h in scan(text)] == [("MIT", 2, 6), ("MIT", 8, 12)]


def common_words(a, b):
    """The longest common subsequence: no alignment in order has more."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_planted_licenses_are_found():
    scanner, rng = licenses.Scanner(licenses.TEMPLATES, 0.8), random.Random(11)
    names = sorted(licenses.TEMPLATES)
    for _ in range(120):
        text, plants = prose(rng.random(), rng.randrange(30)).split(), []
        for name in [rng.choice(names) for _ in range(rng.randrange(5))]:
            notice = licenses.words(licenses.TEMPLATES[name])
            some = [w for w in notice if len(notice) < 25 or rng.random() > 0.06]
            plants.append((name, len(text), len(some)))
            text += [*some, *prose(rng.random(), rng.choice([1, 2, 5, 40, 400])).split()]
        found = scanner.scan(" ".join(text))
        for name, at, n in plants:
            near = [(k, f) for x, _, k, f, l, _ in found if x == name and f < at + n and l >= at]
            assert len(near) == 1 and near[0][0] >= 0.97 * n, (name, at, n, near)  # a stray word before it may align as well
        for name, share, n, first, last, _ in found:
            t = licenses.words(licenses.TEMPLATES[name])
            assert n <= common_words(t, text[first : last + 1]) and share == n / len(t) >= 0.8
            assert any(first < at + k and last >= at for _, at, k in plants)


def test_whole_licenses_from_files(spark, tmp_path):
    rng = random.Random(5)
    own = {"GPL-like": prose(71, 2500, 900), "MPL-like": prose(72, 1200, 900)}
    for name, text in own.items():
        (tmp_path / f"{name}.txt").write_text(text)
    templates = licenses.load_templates(spark, str(tmp_path))
    assert templates == own
    cut = " ".join(w for w in own["GPL-like"].split() if rng.random() > 0.05)
    texts = [f"{prose(1, 50)} {own['MPL-like']} {prose(2, 9)} {cut}", prose(3, 3000, 900), *ODD]
    found = licenses.find_licenses(docs(spark, texts), templates=templates).collect()
    assert [(r.doc_id, r.license_id) for r in found] == [(0, "GPL-like"), (0, "MPL-like")] and 0.9 < found[0].coverage < 1 == found[1].coverage
    assert licenses.find_licenses(docs(spark, texts).limit(0)).count() == 0


def test_rising_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randrange(12) for _ in range(rng.randrange(9))]
        picked = ([v for k, v in enumerate(x) if m >> k & 1] for m in range(1 << len(x)))
        best = max(len(s) for s in picked if all(a < b for a, b in zip(s, s[1:])))
        got = licenses.rising(x)
        assert len(got) == best and all(x[a] < x[b] and a < b for a, b in zip(got, got[1:]))


# --- 3: url filters ---

PAGES = [
    (0, "http://good.example.com/x", '<a href="http://Friend.org/a">'),
    (1, "http://friend.org/", '<a href="//second.org">'),
    (2, "http://second.org/?q", ""),
    (3, "https://bad.net/fr/1", '<a class=x href=http://innocent.org>'),
    (4, "https://bad.net/en/1", ""),
    (5, "http://linker.org#f", '<a href="https://bad.net/fr/"> <a href="https://bad.net/es/"> <A HREF=\'/local\'>'),
    (6, "http://innocent.org/a/b?c#d", None),
    (7, None, None),
    (8, "no-scheme", "<a href='http://bad.net'>"),
    (9, "http://www.example.com/en/1", ""),
    (10, "http://shop.example.com/en/1", ""),
    (10, "http://shop.example.com/en/1", ""),
    (11, "http://EXAMPLE.NET/es/", ""),
    (12, "http://notexample.com", ""),
]


def test_url_verdicts_and_graph(spark):
    df = spark.createDataFrame([(*p, "host", 1) for p in PAGES], "page_id long, url string, html string, host string, rank int")
    rows = {r.page_id: r for r in url_graph.judge(df).collect()}
    want = {
        0: ("good.example.com", "/x", "com/", "allow"), 1: ("friend.org", "/", None, "allow"), 3: ("bad.net", "/fr/1", "net/fr/", "block"),
        4: ("bad.net", "/en/1", None, "block"), 5: ("linker.org", "", None, "block"), 6: ("innocent.org", "/a/b", None, "allow"),
        7: ("", "", None, "allow"), 9: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        10: ("shop.example.com", "/en/1", "example.com/en/", "block"), 11: ("example.net", "/es/", "net/es/", "block"),
        12: ("notexample.com", "", None, "allow")
    }
    assert {k: (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) for k in want} == want
    assert rows[1].trust > rows[2].trust > 0 and rows[5].distrust > 0 and rows[6].distrust == 0
    assert url_graph.judge(df.limit(0)).count() == 0


def test_linkers_of_a_popular_blocked_host(spark):
    pages = [(f"http://bad{n}.net/fr/", "") for n in (10, 100, 10_000)] + [("http://weak.net/fr/", ""), *[(f"http://weak.net/en/{k}", "") for k in range(999)]]
    pages += [
        (f"http://l{k}of{n}.org/", f'<a href="http://bad{n}.net/">')
        for n in (10, 100, 10_000) for k in range(n)
    ] + [("http://ofweak.org/", '<a href="http://weak.net/">')]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = Counter((r.host.split("of")[1], r.verdict) for r in url_graph.judge(df).collect() if "of" in r.host)
    assert got == {("10.org", "block"): 10, ("100.org", "block"): 100, ("10000.org", "block"): 10_000, ("weak.org", "allow"): 1}


def test_walk_against_brute_force(spark, tmp_path):
    from zephyrlake.llm.common import Scratch

    rng = random.Random(2)
    edges = sorted({(f"h{rng.randrange(30)}", f"h{min(rng.randrange(30), rng.randrange(30))}") for _ in range(150)})
    edges = [e for e in edges if e[0] != e[1]]
    seeds = {f"h{k}": url_graph.ONE * (k + 1) // 7 for k in range(0, 30, 7)}
    cfg = url_graph.Propagation()
    got = url_graph.walk(
        spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(seeds.items()), "host string, mass long"), cfg,
        Scratch(spark, "walk"), "w"
    )
    out = Counter(s for s, _ in edges)
    base = {h: m * 15 // 100 for h, m in seeds.items()}
    rank = dict(base)
    for _ in range(cfg.rounds):
        new = Counter(base)
        for s, t in edges:
            new[t] += rank.get(s, 0) * 85 // (100 * out[s])
        rank = dict(new)
    assert {r.host: r.rank for r in got.collect()} == {h: v for h, v in rank.items() if v > 0}


# --- 4: near-duplicates ---


def brute_components(texts, cfg):
    sets = {}
    for k, t in enumerate(texts):
        w = (t or "").encode().translate(near_dedup.ASCII_LOWER).split()
        n = min(cfg.words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and cfg.den * common >= cfg.num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def mutate(text, rate, rng):
    return " ".join(f"{w}{rng.randrange(999)}" if rng.random() < rate else w for w in text.split())


@pytest.mark.parametrize(("block", "block_rows"), [(1_500_000, 256), (2_000, 7)])
def test_near_duplicates_against_brute_force(spark, block, block_rows, monkeypatch):
    if block_rows == 7:  # numbers of classes that clash are drawn anew
        key = near_dedup.class_number
        monkeypatch.setattr(near_dedup, "class_number", lambda digest, salt: key(digest, salt) if salt else F.pmod(key(digest, salt), F.lit(60)))
    rng = random.Random(9)
    base = prose(5, 260, words=5000)
    texts = [*ODD, *ODD, base, base.upper(), *[mutate(base, rng.choice([0.005, 0.02, 0.03, 0.05, 0.08]), rng) for _ in range(90)]]
    texts += [prose(100 + k, rng.randrange(1, 60), 3000) for k in range(60)] + [mutate(prose(100 + k, 50, 3000), 0.03, rng) for k in range(20)]
    cfg = near_dedup.NearDup(words=3, num=85, block=block, block_rows=block_rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts).repartition(5), cfg=cfg).collect()}
    assert got == brute_components(texts, cfg)


def test_word_hashes_cut_as_words(monkeypatch):
    texts = [t for t in ODD if t] + [prose(8, 500), "a b\x0bc\x1fd \x85e"]
    whole = [near_dedup.word_hashes(t) for t in texts]
    for t, h in zip(texts, whole, strict=True):
        w = t.encode().translate(near_dedup.ASCII_LOWER).split()
        assert len(w) == len(h) and len(set(w)) == len(set(h.tolist()))
    monkeypatch.setattr(near_dedup, "PIECE", 64)
    assert all((near_dedup.word_hashes(t) == h).all() for t, h in zip(texts, whole, strict=True))


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0
    rows = spark.createDataFrame(
        [(None, "same words here"), (3, "same words here"), (3, "same words here"), (None, "alone in this")], "doc_id long, text string"
    )
    got = sorted((r.doc_id or -1, r.component_id) for r in near_dedup.near_duplicates(rows).collect() if r.component_id is not None)
    assert got == [(-1, 3), (3, 3), (3, 3)]


def test_near_duplicates_of_ids_with_two_texts(spark):
    a, b, c = (prose(k, 60) for k in (1, 2, 3))
    rows = [(5, a), (5, b), (9, f"{a} x"), (12, f"{b} x"), (7, c), (None, f"{c} x"), (None, c)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string")
        got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect())
        assert got == Counter({(5, 5): 2, (9, 5): 1, (12, 5): 1, (7, 7): 1, (None, 7): 2})


def test_signatures_of_large_sets_differ():
    import numpy as np

    rng, signer = np.random.default_rng(3), near_dedup.Signer(near_dedup.NearDup())
    a, b = (rng.integers(0, 2**63, 3_000_000).astype(np.uint64) for _ in range(2))
    assert not (signer.bands(a) == signer.bands(b)).any()
    mixed = np.concatenate([a[:2_850_000], b[:150_000]])  # similarity 0.9
    same = (signer.signature(a) == signer.signature(mixed)).mean()
    assert 0.83 < same < 0.97


# --- 5: decontamination ---


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_containment_against_brute_force(spark, broadcast_rows):
    rng, cfg = random.Random(6), Decontamination(broadcast_rows=broadcast_rows)
    items = [prose(200 + k, rng.choice([2, 3, 4, 5, 9, 30, 60, 400, 900]), 4000) for k in range(30)] + [None, "", " ... ", "four words only here", "again"]
    texts = list(ODD)
    for _ in range(60):
        t = prose(rng.random(), rng.randrange(5, 900), 4000).split()
        it = mutate(rng.choice([i for i in items if i]), rng.choice([0, 0.01, 0.04, 0.08]), rng)
        at = rng.randrange(len(t) + 1)
        texts.append(" ".join([*t[:at], it.upper(), *t[at:]]).replace(" ", rng.choice([" ", ", ", "\n"])))
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sh = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for d, t in enumerate(texts):
        for i, w in enumerate(map(words, items)):
            a, b = sh(words(t), min(5, len(w))), sh(w, min(5, len(w))) if w else set()
            if b and 100 * len(a & b) >= 80 * len(b):
                want.add((d, i, len(b), len(a & b)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = find_items(docs(spark, texts).union(docs(spark, texts[-5:], len(texts) - 5)), bench, cfg=cfg).collect()
    assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got) == sorted(want) and len(want) > 20
    assert any(len(words(items[i])) < 5 for _, i, _, _ in want)
    assert find_items(docs(spark, texts).limit(0), bench, cfg=cfg).count() == 0 and find_items(docs(spark, texts), bench.limit(0), cfg=cfg).count() == 0
    two = spark.createDataFrame([(None, items[1], 1), (7, "other", 1), (7, items[1], 1), (None, None, 1)], "doc_id long, text string, item_id int")
    assert sorted(r.doc_id or -1 for r in find_items(two, bench, cfg=cfg).collect() if r.item_id == 1) == [-1, 7]


def test_needed_picks_lose_nothing():
    import math

    cfg = Decontamination()
    for size in (1, 4, 5, 30, 200, 513, 2000, 5003):
        for picks in range(1, min(24, size) + 1):
            n, lost = cfg.needed(picks, size), size - math.ceil(0.8 * size)
            under = sum(math.comb(lost, picks - f) * math.comb(size - lost, f) for f in range(n) if picks - f <= lost) / math.comb(size, picks)
            assert n >= 1 and (n == 1 or under <= cfg.miss)


# --- 6: shards ---


def test_shards_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(40), rng.choice([None, *range(9)]), rng.randrange(1, 50), k) for k in range(3000)] + [(5, 5, 9, -1)] * 900 + [(6, 6, 40_000, -2)]
    df = spark.createDataFrame(rows, "h long, i long, size long, n long").repartition(7)
    out = shards.assign(df, "h", "i", "size", shards.Sharding(least_ranges=32, rows_per_range=100))
    got = sorted((r.h, -1 if r.i is None else r.i, r.size, r.shard, r.slot) for r in out.collect())
    keyed = sorted((h, -1 if i is None else i, z) for h, i, z, _ in rows)
    total, at, filled, want = sum(r[2] for r in rows), 0, Counter(), []
    for h, i, z in keyed:
        s = min(15, (at + z // 2) * 16 // total)
        want.append((h, i, z, s, filled[s]))
        filled[s] += 1
        at += z
    assert sorted(want) == got
    assert shards.assign(df.limit(0), "h", "i", "size").count() == 0
    clash = df.withColumns({c: F.col("n") for c in ("Shard", "slot", "start", "copy", "row", "range", "part", "place")})
    out = shards.assign(clash, "h", "i", "size", shards.Sharding(least_ranges=32))
    assert sorted((r.h, -1 if r.i is None else r.i, r.size, r.shard, r.slot) for r in out.collect()) == got
    assert out.columns == ["h", "i", "size", "n", "start", "copy", "row", "range", "part", "place", "shard", "slot"] and out.filter("start <> n").isEmpty()


def test_overfull_ranges_are_divided(spark):
    from zephyrlake.llm.common import Scratch

    rng, cfg = random.Random(3), shards.Sharding(least_ranges=16, oversample=1)
    keys = sorted({(rng.randrange(50) if k % 3 else rng.randrange(10**9), k): rng.choice([1, 5, 90]) for k in range(4000)}.items())
    df = spark.createDataFrame([(h, i, z, 1, z) for (h, i), z in keys], "h long, i long, size long, n long, bytes long").repartition(5)
    total = sum(z for _, z in keys)
    placed = {(r.h, r.i): (r.start, r.place) for r in shards._placed(df, cfg, Scratch(spark, "t"), total, len(keys)).collect()}
    at = 0
    for n, (key, z) in enumerate(keys):
        assert placed[key] == (at, n)
        at += z


# --- 7: toxicity ---


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_evidence_against_brute_force():
    """Every word against every term, and contexts told by whole-text rules."""
    terms = {"idiot": 0.5, "worthless": 1.0, "scum": 0.75, "pathetic": 0.25}
    fuzzy, cfg, rng = {t: toxicity.allowed(t) for t in terms}, toxicity.ToxicConfig(window=3), random.Random(6)
    m = toxicity.Matcher(terms, fuzzy)
    pool = [*terms, "idiott", "Worthles!", "scums", "said", "you", "plain", "words", "here", "and", "there", '"', '"idiot', 'scum"', "\n", "\n>"]
    for _ in range(800):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(25))).replace(" \n ", "\n").replace("\n> ", "\n> ")
        tokens, want, line, quoted_line = [], 0.0, 0, []
        for line in text.split("\n"):
            tokens += line.split()
            quoted_line += [line.lstrip().startswith(">")] * len(line.split())
        clean = [t.lower().strip('"!>') for t in tokens]
        marks = [t.count('"') for t in tokens]
        for k, w in enumerate(clean):
            near = [(d, -terms[t], t) for t in terms if (d := distance(w, t)) <= fuzzy[t]]
            if not near:
                continue
            d, weight, _ = min(near)
            inside = sum(marks) % 2 == 0 and (sum(marks[:k]) % 2 == 1 or marks[k] > 0)
            quoted = inside or quoted_line[k] or any(x in cfg.reporting for x in clean[max(0, k - 3) : k])
            context = 0.2 if quoted else 1.25 if any(x in cfg.address for x in clean[max(0, k - 3) : k + 4]) else 1.0
            want += -weight * context * (1.0, 0.85, 0.7)[d]
        assert toxicity.evidence(text, m, cfg) == pytest.approx(want), text


def test_levenshtein_product_against_brute_force():
    rng = random.Random(3)
    terms = ["idiot", "worthless", "scum", "moron", "pathetic", "disgusting", "lowe*"]
    m = toxicity.Matcher(dict.fromkeys(terms, 1.0), {t: toxicity.allowed(t) for t in terms})
    words = [*vocabulary(5, 300), *terms]
    for t in terms:
        for _ in range(60):
            w = list(t.rstrip("*"))
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "z", "1"])
            words.append("".join(w))
    for w in words:
        best = min((d for t in terms if not t.endswith("*") and (d := distance(w, t)) <= toxicity.allowed(t)), default=0 if w.startswith("lowe") else None)
        hit = m.find(w)
        assert (None if hit is None else hit[1]) == (0 if w.startswith("lowe") and best is not None else best), w


def test_quotation_counts_for_less():
    m = toxicity.Matcher({"idiot": 1.0}, {"idiot": 1})
    e = lambda t: toxicity.evidence(t, m, toxicity.ToxicConfig())
    assert e("you are an idiot") > e("an 1diot") > e('he was called "an idiot" there') > 0 == e("nothing") == e(None)
    assert e("> an idiot\nfine") < e("an idiot\nfine") and e("she said idiot") < e("what an idiot")


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        t, bad = prose(1000 + k, 40).split(), k % 5 == 0
        if bad:
            t[rng.randrange(40)] = rng.choice(["moronic", "worthless", "scumbag", "idiotic"])
        rows.append(" ".join(t))
        labels.append((k, int(bad), None))
    df = docs(spark, [*rows, *ODD])
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, None), (5, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, lab, ~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == 900 + len(ODD) and all(0 <= s <= 1 for s in got.values())
    right = [(got[k] >= 0.7) == bool(y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(right) > 200 and sum(right) >= 0.98 * len(right)
    assert len({round(got[900 + k], 9) for k in range(len(ODD))}) == 1
    twice = toxicity.fit(df.union(df.filter("doc_id < 900")), lab, ~toxicity.held_out())
    assert (twice.terms, twice.fuzzy, twice.weights) == (model.terms, model.fuzzy, model.weights)
    empty = toxicity.fit(df, lab.limit(0), ~toxicity.held_out())
    assert empty.terms == {} and toxicity.score(df, empty).first().score == pytest.approx(0.5)
    assert toxicity.score(df.limit(0), model).count() == 0


# --- 8: line dedup ---


def test_lines_against_sql(spark):
    rng = random.Random(12)
    lines = [prose(k, rng.choice([2, 5, 12, 30, 60]), 900) for k in range(40)] + ["", "The end."]
    texts = list(ODD) + ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    df = docs(spark, texts).repartition(4)
    out = {r.doc_id: r for r in line_dedup.remove_repeats(df).collect()}
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = {i: (t, n) for i, t, n in con.sql(line_dedup.OP8_SQL).fetchall()}
    assert {k: (r.text, r.removed_chunks) for k, r in out.items()} == want and sum(n for _, n in want.values()) > 20
    assert out[0].version == 1 and out[0].h == 3
    passage = prose(77, 55, 900)
    pair = docs(spark, [f"one line\n{passage}\nlast", f"{passage}\nother", "one line\nother"])
    left = {r.doc_id: r.text for r in line_dedup.remove_repeats(pair).collect()}
    assert left == {0: f"one line\n{passage}\nlast", 1: "other", 2: "one line\nother"}
    assert line_dedup.remove_repeats(df.limit(0)).count() == 0
    named = pair.withColumns({c: F.lit(7) for c in ("removed_chunks", "gone_chunks", "text_version", "id", "pos", "c")})
    kept = {r.doc_id: r for r in line_dedup.remove_repeats(named, count_col="n").collect()}
    assert {k: r.text for k, r in kept.items()} == left and kept[1].n == 1 and all(r.removed_chunks == r.pos == r.gone_chunks == 7 for r in kept.values())


def test_passages_of_lines_of_any_length(spark):
    """Passages of over 50 words, each in two texts: of lines of 12 words or more all goes, of shorter ones what is between boundaries."""
    rng, texts, of = random.Random(21), [], {}
    line = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(n))
    for words in (5, 8, 12, 20, 30, 49, 60):
        for lines in range(max(1, -(-51 // words)), 13):
            passage = [line(words) for _ in range(lines)]
            for _ in range(2):
                around = [line(rng.randrange(1, 30)) for _ in range(6)]
                of[len(texts)] = (words, passage, around)
                texts.append("\n".join([*around[:3], *passage, *around[3:]]))
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.remove_repeats(docs(spark, texts)).collect()}
    had = gone = 0
    for k, (words, passage, around) in of.items():
        assert [x for x in out[k] if x not in passage] == around  # nothing else goes
        left = [x for x in out[k] if x in passage]
        assert left == passage if k % 2 == 0 else words < 12 or left == []
        if k % 2 and words < 12:
            had, gone = had + len(passage), gone + len(passage) - len(left)
    assert gone > 0.6 * had


# --- 9: chat ---


def test_template_is_reversible():
    rng = random.Random(1)
    for _ in range(300):
        turns = [
            (
                "".join(rng.choice("ab<>/\\\n lgnturn") for _ in range(rng.randrange(5))),
                "".join(rng.choice("<>/\\\nlgn turn é😀") for _ in range(rng.randrange(20)))
            )
            for _ in range(rng.randrange(5))
        ]
        turns.append(("assistant", "<turn user>\\l\\\n</turn>"))
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert text.count("<") == 2 * len(turns)
    with pytest.raises(ValueError):
        chat.parse_turns("<turn a>\nno end")


def test_reply_paths_against_brute_force(spark):
    rng = random.Random(5)
    rows, tree = [], {}
    for t in range(12):
        n = rng.randrange(1, 40)
        for k in range(n):
            parent = None if k == 0 else rng.randrange(k) if t % 3 else k - 1
            tree[(t, k)] = (parent, float(rng.randrange(5)))
            rows.append((t, k, parent, "user" if k % 2 else "assistant", f"t{k}", tree[(t, k)][1]))
    rows += [
        (99, 1, 2, "user", "loop", 1.0), (99, 2, 1, "user", "loop", 1.0), (50, 7, 8, "user", "orphan", None),
        (50, None, None, "user", "no id", 1.0), rows[0]
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    want = {}
    for t in range(12):
        own = {k: v for (a, k), v in tree.items() if a == t}
        leaves = set(own) - {p for p, _ in own.values()}
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = own[at][0]
            want[(t, leaf)] = (path[::-1], sum(own[k][1] for k in path))
    want[(50, 7)] = ([7], 0.0)
    got = defaultdict(list)
    rank = {}
    for r in chat.reply_paths(df, top=None).collect():
        got[(r.tree, r.leaf)].append((r.depth, r.node))
        rank[(r.tree, r.leaf)] = (r.path_rank, r.path_score)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {k: p for k, (p, _) in want.items()}
    assert all(rank[k][1] == s for k, (_, s) in want.items())
    best = {r.tree: (r.leaf, r.path_score) for r in chat.reply_paths(df, top=1).collect()}
    assert all(best[t][1] == max(s for (a, _), (_, s) in want.items() if a == t) for t in best) and set(best) == {a for a, _ in want}
    made = {r.tree: r for r in chat.format_paths(chat.reply_paths(df)).collect()}
    assert chat.parse_turns(made[50].formatted) == [("user", "orphan")] and made[50].loss_spans == []
    assert chat.reply_paths(df.limit(0)).count() == 0


# --- 10: pieces ---


def test_pieces_without_dropout_are_the_models_own():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(pieces.load(pieces.MODEL), pieces.Dropout(dropout=0.0))
    for t in [prose(k, 200) for k in range(20)] + ["  a  b ", "\n\n \n", "日本 😀 é́", "a" * 3000, "Keine Übung, ça va?"]:
        assert e.encode(t) == sp.encode(t)


def test_dropout_varies_and_stays_lossless(spark):
    texts = [*ODD, *[prose(k, 150) for k in range(10)]]
    p = pieces.load(pieces.MODEL)
    a, b, c = (pieces.Encoder(p, pieces.Dropout(seed=s, dropout=0.2)) for s in (1, 1, 2))
    made = [[e.encode(t, v) for t in texts] for e, v in ((a, 0), (b, 0), (c, 0), (a, 1))]
    assert made[0] == made[1] and made[0] != made[2] and made[0] != made[3]
    assert all(p.decode(x) == (t or "") for m in made for x, t in zip(m, texts, strict=True))
    df = docs(spark, texts)
    rows = pieces.encode(df)
    got = {r.doc_id: r for r in pieces.decode(rows).collect()}
    assert all(got[k].text == (t or "") and got[k].lossless and got[k].n_pieces == len(got[k].ids) for k, t in enumerate(texts))
    assert pieces.encode(df.limit(0)).count() == 0


def plain_dropout(p, text, key, bar):
    """Each run's candidates one after another, each with its own draw, without memory or shortcuts; and the draws."""
    ids, drawn = [], []
    for r, run in enumerate(p.runs.findall(" " + text)):
        sym, gone, n = [pieces.SPACE if c == " " else pieces.LITERAL if c == pieces.SPACE else c for c in run], set(), 0
        at = list(range(len(sym)))
        while True:
            can = [(p.cost[a + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a + b in p.cost and (at[i], a, b) not in gone]
            if not can:
                break
            i = min(can)[1]
            drawn.append(bool(pieces.skips(key, [r], [n], bar)[0]))
            n += 1
            if drawn[-1]:
                gone.add((at[i], sym[i], sym[i + 1]))
            else:
                sym[i : i + 2] = [sym[i] + sym[i + 1]]
                del at[i + 1]
        for s in sym:
            ids += [p.id[s]] if s in p.id else [p.bytes_[b] for b in (pieces.SPACE if s == pieces.LITERAL else s).encode()]
    return ids, drawn


def test_runs_and_parts_of_texts():
    import numpy as np

    p, rng = pieces.load(pieces.MODEL), random.Random(2)
    for cut_spaces, cut_lines, pattern in ((True, True, p.runs.pattern), (True, False, r" +[^ ]*|[^ ]+"), (False, False, r"[\s\S]+")):
        q = pieces.Pieces(pieces.read_model(pieces.MODEL))
        q.cut_spaces, q.cut_lines = cut_spaces, cut_lines
        for _ in range(200):
            text = " " + "".join(rng.choice("ab \n\t▁é") for _ in range(rng.randrange(12)))
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            starts = q.run_starts(points, np.array([0])).tolist()
            assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] == re.findall(pattern, text)
    texts = [*ODD, prose(4, 900), None, "日本 " * 300]
    whole, parts = (pieces.Encoder(p, pieces.Dropout(letters=n)).encode_all(texts, list(range(len(texts)))) for n in (10**6, 70))
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_dropout_against_plain_agenda():
    import xxhash

    p, drawn = pieces.load(pieces.MODEL), []
    for rate in (0.1, 0.5):
        e = pieces.Encoder(p, pieces.Dropout(dropout=rate, letters=50))
        for k, t in enumerate([prose(3, 300), prose(3, 300), "unbelievable ▁ 日本 " * 9, "internationalisation" * 8, "a", " "]):
            want, d = plain_dropout(p, t, xxhash.xxh64_intdigest(b"%d" % k, e.cfg.seed * 2), e.bar)
            assert e.encode(t, k) == want
            drawn += d if rate == 0.1 else []
    assert len(drawn) > 2000 and 0.08 < sum(drawn) / len(drawn) < 0.12


def test_dropout_varies_by_occurrence_and_document(spark):
    p = pieces.load(pieces.MODEL)
    copies = [r.ids for r in pieces.encode(docs(spark, ["the internationalisation of information"] * 300)).select("ids").collect()]
    assert len(set(map(tuple, copies))) > 30
    once = pieces.Encoder(p, pieces.Dropout()).encode(" ".join(["information"] * 400), 7)
    assert len(set("|".join(p.out[i] for i in once).split("| "))) > 10
    rows = spark.createDataFrame([(None, "some information"), (None, "some information"), (4, None)], "doc_id long, text string")
    got = [r.ids for r in pieces.encode(rows).collect() if r.ids]
    assert got[0] == got[1] and len(got) == 2


# --- the registered queries ---


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(
        map(repr, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    )


def test_op1_digests(spark, db):
    text = dict(db.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.QUERIES["op1_media"](spark, DATA).collect():
        data = text[r.doc_id].encode()
        payload = media.pad(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
        )
        stored = media.write_stream(payload)
        assert plain_demux(stored) == payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_op4_and_op6(spark, db):
    text = dict(db.sql("SELECT doc_id, text FROM documents").fetchall())
    ids = sorted(text)
    want = brute_components([text[k] for k in ids], near_dedup.NearDup(words=3, num=85))
    for r in queries.QUERIES["op4_near_dedup"](spark, DATA).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (
            want[ids.index(r.doc_id)][0], ids[want[ids.index(r.doc_id)][1]], r.doc_id == ids[want[ids.index(r.doc_id)][1]]
        )
    rows = queries.QUERIES["op6_sharding"](spark, DATA).collect()
    load = Counter()
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
    assert set(load) <= set(range(16)) and max(load.values()) - sum(load.values()) / 16 <= max(r.size for r in rows)
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
