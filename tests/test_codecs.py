"""Coders against golden bytes, each other, and their own way back."""

import numpy as np
import pytest

from bitloom.functions import huffman, mmr, mq, pages, regions
from bitloom.functions import symbolcoding as sc
from bitloom.operators import documents
from bitloom.sources import streams as st

#: The test sequence of annex H.2 of the standard.
PLAIN = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
CODED = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")


def noise(seed, h, w, share=0.5):
    return (np.random.default_rng(seed).random((h, w)) < share).astype(np.uint8)


def paper(seed=1, h=120, w=90):
    rng = np.random.default_rng(seed)
    out = np.zeros((h, w), np.uint8)
    glyphs = [noise(k, rng.integers(4, 9), rng.integers(4, 8), 0.6) for k in range(9)]
    for y in range(3, h - 10, 12):
        for x in range(2, w - 9, 10):
            g = glyphs[rng.integers(9)].copy()
            if rng.random() < 0.3:
                g[rng.integers(g.shape[0]), rng.integers(g.shape[1])] ^= 1
            out[y : y + g.shape[0], x : x + g.shape[1]] |= g
    return out


def test_arithmetic_coder_golden_bytes():
    bits = np.unpackbits(np.frombuffer(PLAIN, np.uint8)).tolist()
    enc, states = mq.Encoder(), bytearray(1)
    for b in bits:
        enc.bit(states, 0, b)
    assert enc.finish() == CODED
    dec, states = mq.Decoder(CODED), bytearray(1)
    assert [dec.bit(states, 0) for _ in bits] == bits
    flock = mq.Flock([CODED, CODED[:9], CODED], 1)
    got = np.stack([flock.bits(np.zeros(3, np.int64)) for _ in bits], 1)
    assert got[0].tolist() == got[2].tolist() == bits


def test_an_empty_region_is_four_golden_bytes():
    assert mq.Decoder(bytes([85, 255, 127, 240])).a == 0x8000  # any bytes decode to something
    enc = mq.Encoder()
    assert mq.Encoder().finish() == enc.finish()


@pytest.mark.parametrize("template", range(4))
@pytest.mark.parametrize("typical", [False, True])
def test_generic_regions(template, typical):
    b = paper()
    enc = mq.Encoder()
    regions.encode_generic(enc, b, template, typical=typical)
    data = enc.finish()
    assert (regions.decode_generic(mq.Decoder(data), b.shape[1], b.shape[0], template, typical=typical) == b).all()
    # the slow way: pixel by pixel, context by context
    states, dec, out, same = bytearray(1 << 16), mq.Decoder(data), np.zeros((b.shape[0] + 2, b.shape[1] + 8), np.uint8), 0
    for y in range(12):
        if typical:
            same ^= dec.bit(states, regions.TYPICAL[template])
            if same:
                out[y + 2] = out[y + 1]
                continue
        for x in range(b.shape[1]):
            k = sum(int(out[y + 2 + dy, x + 4 + dx]) << i for i, (dx, dy) in enumerate(regions.pixels(template)))
            out[y + 2, x + 4] = dec.bit(states, k)
    assert (out[2:14, 4:-4] == b[:12]).all()
    copies = [data, data, data]
    assert (regions.decode_many(copies, b.shape[1], b.shape[0], template, typical=typical) == b).all()


def test_generic_regions_with_other_pixels_and_skips():
    b = paper(2)
    for args in ({"at": ((-5, 0), (-3, -1), (2, -2), (-7, -3))}, {"extended": True}, {"skip": noise(9, *b.shape)}):
        bitmap = np.where(args["skip"], 0, b).astype(np.uint8) if "skip" in args else b
        enc = mq.Encoder()
        regions.encode_generic(enc, bitmap, 0, **args)
        assert (regions.decode_generic(mq.Decoder(enc.finish()), b.shape[1], b.shape[0], 0, **args) == bitmap).all()
    with pytest.raises(ValueError):
        regions.pixels(3, ((0, 0),))


@pytest.mark.parametrize("template", [0, 1])
@pytest.mark.parametrize("typical", [False, True])
def test_refinement(template, typical):
    old, new = paper(3), paper(3, 100, 80)
    new[::9, ::7] ^= 1
    for dx, dy in ((0, 0), (2, -3)):
        enc = mq.Encoder()
        regions.encode_refinement(enc, new, old, dx, dy, template, typical=typical)
        assert (regions.decode_refinement(mq.Decoder(enc.finish()), 80, 100, old, dx, dy, template, typical=typical) == new).all()


def test_integers_and_ids():
    values = [0, 3, 4, 19, 20, 83, 84, 339, 340, 4435, 4436, 10**6, -1, -4436, None, 2**31]
    enc, a, b = mq.Encoder(), bytearray(512), bytearray(1 << 9)
    for k, v in enumerate(values):
        mq.encode_integer(enc, a, v)
        mq.encode_id(enc, b, 9, 31 * k)
    dec, a, b = mq.Decoder(enc.finish()), bytearray(512), bytearray(1 << 9)
    assert [(mq.decode_integer(dec, a), mq.decode_id(dec, b, 9)) for _ in values] == [(v, 31 * k) for k, v in enumerate(values)]
    assert [mq.code_length(n) for n in (0, 1, 2, 3, 4, 5, 64, 65, 2**20 + 1)] == [0, 0, 1, 2, 2, 3, 6, 7, 21]


@pytest.mark.parametrize("number", range(1, 16))
def test_standard_tables(number):
    t = huffman.standard(number)
    assert sum(2.0 ** -line[1] for line in t.lines) == 1
    spans = sorted((low, low + (1 << size)) for kind, _, size, low in t.lines if not kind)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # neither holes nor overlaps
    for v in [*range(-3000, 5000, 13), *range(-40, 90), None, 10**6, -(10**6)]:
        w = huffman.Writer()
        try:
            t.encode(w, v)
        except ValueError:
            assert v is None or v < spans[0][0] or v >= spans[-1][1]
            continue
        assert t.decode(huffman.Reader(w.finish())) == v


def test_sent_tables_and_symbol_codes():
    t = huffman.sent(huffman.send(-5, [(2, 2), (2, 3), (3, 1)], 4, 4, 3))
    assert t.lines == [("", 2, 2, -5), ("", 2, 3, -1), ("", 3, 1, 7), ("lower", 4, 32, -6), ("upper", 4, 32, 9), ("oob", 3, 0, 0)]
    assert huffman.canonical([1, 2, 3, 3, 0]) == [0, 2, 6, 7, 0]
    w = huffman.Writer()
    for k in range(35):
        w.bits({3: 2, 32: 2, 33: 2, 34: 2}.get(k, 0), 4)
    codes = {k: i for i, k in enumerate((3, 32, 33, 34))}
    for k, extra in ((3, ()), (32, (0, 2)), (33, (1, 3)), (34, (2, 7)), (3, ())):
        w.bits(codes[k], 2)
        if extra:
            w.bits(*extra)
    w.align()
    table = huffman.read_id_codes(huffman.Reader(w.finish()), 4 + 4 + 13 + 1)
    assert [x[1] for x in table.lines] == [3] * 4 + [0] * 4 + [0] * 13 + [3]


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (40, 700), (2, 6000), (0, 5), (5, 0)])
@pytest.mark.parametrize("share", [0, 0.01, 0.1, 0.5, 1])
def test_fax(shape, share):
    b = noise(7, *shape, share)
    for bitmap in (b, np.repeat(np.repeat(b, 3, 0), 5, 1)[: shape[0], : shape[1]]):
        data = mmr.encode(bitmap)
        got, end = mmr.decode(data + b"zz", shape[1], shape[0])
        assert (got == bitmap).all() and end == len(data)


def test_fax_codes_and_lines():
    for runs in mmr.RUNS:
        codes = list(runs.values())
        assert len(set(codes)) == 104 and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert mmr.decode_line(mmr.encode_line([0, 5, 3000, 64, 7]), 3076) == [0, 5, 3000, 64, 7]
    with pytest.raises(ValueError):
        mmr.decode(b"\0", 9, 9)


@pytest.fixture(scope="module")
def symbols():
    rng = np.random.default_rng(3)
    return sorted((noise(k, rng.integers(1, 9), rng.integers(1, 9)) for k in range(12)), key=lambda s: s.shape)


@pytest.mark.parametrize("huff", [False, True])
def test_symbol_dictionaries(symbols, huff):
    for template in (0,) if huff else range(4):
        rules = sc.SymbolRules(12, 12, huff, template=template)
        assert all((a == b).all() for a, b in zip(sc.decode_symbols(sc.encode_symbols(rules, symbols), rules, []), symbols, strict=True))
    imported, new = symbols[:5], [noise(40, 4, 5), None, noise(41, 7, 6)]
    parts = [sc.Instance(0, 0, 0), sc.Instance(2, 1, 1), sc.Instance(5, 0, 0, noise(42, 5, 6))]
    rules = sc.SymbolRules(3, 3, huff, True)
    new[1] = sc.draw_text(sc._aggregate_rules(rules, 8, 6, 3), [*imported, new[0]], parts)
    data = sc.encode_symbols(rules, new, imported, {0: (3, 1, -1), 2: (6, 0, 0)}, {1: parts})
    assert all((a == b).all() for a, b in zip(sc.decode_symbols(data, rules, imported), new, strict=True))


@pytest.mark.parametrize("huff", [False, True])
@pytest.mark.parametrize("corner", range(4))
@pytest.mark.parametrize("transposed", [False, True])
def test_text_regions(symbols, huff, corner, transposed):
    rng = np.random.default_rng(corner)
    instances = [sc.Instance(int(rng.integers(12)), int(rng.integers(0, 90)), int(rng.integers(0, 50))) for _ in range(40)]
    for k in instances[::3]:
        h, w = symbols[k.symbol].shape
        k.bitmap = noise(k.x, h + k.y % 2, w + 1)
    for log, offset, template in ((0, 0, 0), (2, -3, 1), (3, 5, 0)):
        rules = sc.TextRules(100, 60, 40, huff, True, log, corner, transposed, 2, 0, offset, template)
        assert (sc.decode_text(sc.encode_text(rules, symbols, instances), rules, symbols) == sc.draw_text(rules, symbols, instances)).all()


@pytest.mark.parametrize("template", range(4))
@pytest.mark.parametrize("fax, skip", [(False, False), (False, True), (True, False)])
def test_halftones(template, fax, skip):
    rng = np.random.default_rng(template)
    patterns = [noise(k, 4, 4, k / 9) for k in range(10)]
    values = rng.integers(0, 10, (11, 13))
    (page,) = pages.decode_document(pages.encode_halftone(values, patterns, 0 if fax else template, fax, skip))
    assert page.error is None and (page.bitmap == np.block([[patterns[v] for v in row] for row in values])).all()
    assert (regions.from_gray_planes(regions.gray_planes(values, 4)) == values).all()
    turned = regions.draw_halftone((30, 30), values % 10, patterns, (256 * 9, -256, 700, 300))
    assert turned.shape == (30, 30) and regions.halftone_skip((30, 30), (11, 13), (256 * 9, -256, 700, 300), (4, 4)).any()


@pytest.mark.parametrize("rules", [*pages.PRESETS.values(), pages.EncodeRules("mmr"), pages.EncodeRules("symbol_huffman"), pages.EncodeRules("symbol_huffman", disagreement=0.2, refine=True), *(pages.EncodeRules("generic", t, bool(t % 2)) for t in range(4))])
def test_pages_come_back(rules):
    want = [paper(), paper(5, 30, 33), np.zeros((7, 9), np.uint8), np.ones((1, 1), np.uint8)]
    data, modes = pages.encode_document(want, rules)
    got = pages.decode_document(data)
    assert len(modes) == len(got) == 4 and not any(p.error for p in got)
    assert all((p.bitmap == w).all() for p, w in zip(got, want))
    assert not st.Parser(data).said


def test_lossy_pages_merge_symbols():
    page = paper()
    lossy, exact = (pages.encode_document([page], pages.EncodeRules("symbol", disagreement=d))[0] for d in (0.3, 0))
    (got,) = pages.decode_document(lossy)
    assert len(lossy) < len(exact) and 0 < (got.bitmap != page).sum() < 0.1 * page.sum()
    assert pages.xor_distance(np.ones((2, 2), np.uint8), np.ones((4, 4), np.uint8)) == (12, 3.0)
    a, b, c = np.ones((5, 5), np.uint8), np.ones((5, 6), np.uint8), np.ones((5, 8), np.uint8)
    assert pages.leaders([a, b, c], [1, 5, 1], 0.25) == [1, 1, 2]


def test_damaged_streams_end_with_an_error(monkeypatch):
    monkeypatch.setattr(pages, "LIMIT", 1 << 15)
    monkeypatch.setattr(pages, "COUNT", 500)
    monkeypatch.setattr(sc, "LARGEST", 1 << 12)
    data = bytearray(pages.encode_document([paper()], pages.EncodeRules("symbol"))[0])
    rng = np.random.default_rng(0)
    for at in rng.integers(13, len(data), 25):
        hurt = bytearray(data)
        hurt[at] ^= 1 << int(rng.integers(8))
        pages.decode_document(bytes(hurt))
    for cut in range(0, len(data), 97):
        pages.decode_document(bytes(data[:cut]))


def test_regions_of_unknown_length_stripes_and_references():
    b = paper(4, 40, 50)
    body = pages.generic_body(b, pages.EncodeRules("generic", 1, False))
    unknown = st.segment_bytes(1, 38, body + (40).to_bytes(4, "big"), 1, unknown_length=True)
    page = st.segment_bytes(0, 48, st.page_bytes(50, 0xFFFFFFFF, 0, 0x8000 | 40), 1)
    stream = st.file_header(1) + page + unknown + st.segment_bytes(2, 50, st.end_of_stripe_bytes(39), 1) + st.segment_bytes(3, 49, b"", 1)
    (got,) = pages.decode_document(stream)
    assert got.error is None and (got.bitmap == b).all()
    new = b.copy()
    new[3:9, 4:20] ^= 1
    enc = mq.Encoder()
    regions.encode_refinement(enc, new, b)
    refine = st.region_bytes(50, 40, flags=4) + b"\0" + bytes([255] * 4) + enc.finish()
    for first, refs in ((36, [1]), (38, [])):  # an intermediate region, or the page
        stream = st.file_header(1) + st.segment_bytes(0, 48, st.page_bytes(50, 40), 1) + st.segment_bytes(1, first, body, 1) + st.segment_bytes(2, 42, refine, 1, refs)
        (got,) = pages.decode_document(stream)
        assert got.error is None and (got.bitmap == new).all()


def test_tables_of_documents(spark):
    want = {("a", 1): paper(6), ("a", 2): paper(7, 20, 17), ("b", 1): np.zeros((3, 3), np.uint8)}
    rows = [(s, p, b.shape[1], b.shape[0], documents.pack(b)) for (s, p), b in want.items()]
    df = spark.createDataFrame(rows, "sid string, page bigint, width bigint, height bigint, bits binary")
    made = documents.encode_documents(df)
    decoded = documents.decode_pages(made.select("sid", "content").union(spark.createDataFrame([("n", None), ("bad", b"nothing")], "sid string, content binary")))
    got = {(r.sid, r.page): documents.unpack(r.bits, r.width, r.height) for r in decoded.collect()}
    assert got.keys() == want.keys() and all((got[k] == b).all() for k, b in want.items())
    other = df.selectExpr("sid", "page", "width", "height", "bits", "cast(null as string) error")
    assert {r.verdict for r in documents.compare_pages(decoded, other).collect()} == {"OK"}
    assert {r.verdict for r in documents.compare_pages(decoded, other.where("page = 1")).collect()} == {"OK", "MISSING"}
