"""Parts without Spark, against plain versions."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa

from wordloom.llm import blocks, bpe, caps, chat, packing, pii, sketch, training, wordsets


def plain_shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_shingle_sets():
    r = random.Random(1)
    texts = [None, "", " \n", "One", "one two", "A b\x0bc\rd a B c d", "é È x x x x x x"] + ["".join(r.choice("ab C\t\n") for _ in range(r.randrange(200))) for _ in range(200)]
    for k in (1, 3, 5):
        found = list(wordsets.sets(pa.array(texts), k))
        assert [len(s) for s in found] == [len(plain_shingles(t, k)) for t in texts]
        for a in range(0, 60):
            for b in range(a):
                assert len(np.intersect1d(found[a], found[b])) == len(plain_shingles(texts[a], k) & plain_shingles(texts[b], k)), (a, b)
    sliced = pa.array(texts).slice(5)
    assert [len(s) for s in wordsets.sets(sliced, 3)] == [len(plain_shingles(t, 3)) for t in texts[5:]]


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for n, t in ((1, 64), (5, 64), (900, 512), (3000, 512)):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 10 : n + n // 10])
        x, y = sketch.sketch(a, t), sketch.sketch(b, t)
        assert x.max() >> np.uint64(48) < 2 * t
        if n > 100:
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(float((x == y).mean()) - j) < 0.1


REGEX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for rank, kind in enumerate(pii.BASE):
        for m in re.finditer(REGEX[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
                ok = 12 <= len(digits) <= 19 and total % 10 == 0
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_pii_equals_plain_regexes():
    r = random.Random(2)
    bits = ["a@b.c", "x.y@z", "@", ".", "1.2.3.4", "300.1.1.1", "0007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456-78", "+1", " ", "-", "12", "é", "\n", "a", "%", "1.2.3.4.5.6.7.8", "79927398713000"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        assert [s[:3] for s in pii.find_spans(text) if s.kind in pii.BASE] == plain_spans(text), text
    long = "9" * 50_000 + "a" * 50_000 + "@" + "." * 1000 + "1." * 20_000
    assert [(s.kind, s.end - s.start) for s in pii.find_spans(long) if s.kind in pii.BASE] == [("ip", 7)] * 5000
    assert any(s.kind == "iban" for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 00 please"))
    assert not any(s.kind == "iban" for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 01 please"))
    assert any(s.kind == "ssn" for s in pii.find_spans("my SSN: 123-45-6789"))
    assert not any(s.kind == "ssn" for s in pii.find_spans("part 123-45-6789"))
    assert pii.mask("to a@b.cd now", pii.find_spans("to a@b.cd now")) == "to [EMAIL] now"


def test_ibans_before_other_words():
    numbers = ["BE68 5390 0754 7034", "AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    for n in numbers:
        for after in ("", " BIC", " EUR", " 2024", " GEBABEBB", " BIC GEBABEBB", ", BIC", " A", " AB12", " please"):
            assert [(s.kind, s.start, s.end) for s in pii.find_spans(f"IBAN {n}{after}") if s.kind == "iban"] == [("iban", 5, 5 + len(n))], (n, after)
    text = "bank " + " ".join(numbers)
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == numbers
    assert pii.mask(f"IBAN {numbers[0]} BIC X", pii.find_spans(f"IBAN {numbers[0]} BIC X")) == "IBAN [IBAN] BIC X"
    assert any(s.kind == "iban" for s in pii.find_spans("IBAN AA12 3456 BE68 5390 0754 7034 BIC"))
    assert not any(s.kind == "iban" for s in pii.find_spans("IBAN BE68 5390 0754 7035 BIC"))
    assert len(pii.find_spans("AA11 1111 " * 20_000)) == 0


def test_bpe_equals_the_library():
    whole = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1 << 30)
    r = random.Random(4)
    bits = ["hello", " world", "  ", "\n\n", "'ll", "'", "é日本", "12345", "!?", "\t", " a", "x" * 40, " ", "\x1c", " ", "🙂", ""]
    for leaf in (1, 3, 17, 64):
        codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf)
        for _ in range(400):
            text = "".join(r.choice(bits) for _ in range(r.randrange(40)))
            ids = codec.encode(text)
            assert ids.tolist() == whole.encoding.encode_ordinary(text), (leaf, text)
            assert codec.decode(ids) == text.encode()


def test_bpe_takes_all_of_a_very_long_text():
    class Long(str):
        def __len__(self):
            return (1 << 30) + 5

    codec, text = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 1 << 40), Long("a")
    codec._ids = lambda part: part
    assert codec.encode(text) is text


def test_tokens_of_every_letter():
    """Each character below U+3000 inside, before and after words, with suffixes, controls and special strings."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.Tokens(path)
    assert own.split
    odd = [f"{c}A{c}'S I'VE{c} don't{c}x <|endoftext|>{c}y Stra\u00dfe{c} a\x0bb 12,5{c}" for c in map(chr, range(0x3000))]
    for text in odd:
        assert own(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_words_are_encoded_apart():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), packing.Tokens(path)
    r = random.Random(5)
    bits = ["Hello", " ", "\n", "́", "e", "É", "ς", "Σ", "don't", "12", " ", "　", "\x1c", "\x85", "!!", "<|endoftext|>", "日本", "İ", "\r", "\t", "\x0b"]
    for _ in range(800):
        text = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert np.frombuffer(own(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_patterns_hold_the_demand():
    r = np.random.default_rng(6)
    sizes = np.unique(r.integers(1, 100, 60))  # none over half, so the volume is a near bound
    demand = r.integers(1, 400, len(sizes))
    plan = packing.patterns(demand, sizes, 256)
    assert (sum(t * c for t, c in plan) == demand).all()
    assert all(t > 0 and int(c @ sizes) <= 256 for t, c in plan)
    assert sum(t for t, _ in plan) <= 1.02 * (demand @ sizes) / 256 + 60
    assert packing.patterns(np.zeros(0, int), np.zeros(0, int), 256) == []


def test_chat_escapes_are_reversible():
    r = random.Random(7)
    bits = ["\\", "<|", "|>", "<", "|", ">", "</s>", "[INST]", "[/INST]", "<|end|>", "\n", "a", "<<SYS>>"]
    for _ in range(2000):
        text, role = ("".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(2))
        segment, a, b = chat.render(role, text)
        assert chat.parse(segment) == (role, text)
        assert chat.unescape(segment[a:b]) == text
        assert sum(bool(m) for m in re.findall(r"\\.|(<\|end\|>)", segment, re.S)) == 1  # an escape and what it escapes are skipped


def test_blocks_and_labels():
    page = "<title>t</title><script>var a='</p>';</script><nav><a href=x>Home</a></nav><article><h1>A &amp; b</h1><p><b>One<br>two<p>Three  \n four.</article><footer>&copy; x</footer>"
    assert [b.text for b in blocks.blocks(page)] == ["Home", "A & b", "One two", "Three four.", "© x"]
    assert blocks.main_texts([page, "", "<", "plain text"])[0] == "A & b\n\nOne two\n\nThree four."
    assert blocks.main_texts([""]) == [""]
    assert training.accuracy(blocks.trained(), 150, seed=99) > 0.99
    assert blocks.blocks("<" * 20_000) and blocks.blocks('<a "' * 5_000) is not None


def test_words_do_not_collide_by_structure():
    """Thue-Morse words and their complements are equal for any polynomial modulo a power of two."""
    words, w = [], "a"
    for _ in range(12):
        w += w.translate(str.maketrans("ab", "ba"))
        words += [w, w.translate(str.maketrans("ab", "ba"))]
    words += ["x" * n for n in range(1, 600)] + ["\0" * n for n in range(1, 300)]
    found = [x for s in wordsets.sets(pa.array(words), 1) for x in s.tolist()]
    assert len(found) == len(set(words)) == len(set(found))


def test_cap_directions_are_all_that_exceed():
    """List decoding against every direction, and recall at the threshold in several dimensions."""
    rng = np.random.default_rng(9)
    how = caps.Caps(codes=2, most=40)
    for dim in (1, 5, 17, 64):
        unit = rng.standard_normal((40, dim))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        code = caps.Code(dim, 10_000, how)
        row, direction = code.filters(unit)
        expected, doubtful = set(), set()
        for k, (turn, one, two) in enumerate(code.halves):
            spun = np.pad(unit, ((0, 0), (0, code.pad))) @ turn
            mid = spun.shape[1] // 2
            score = (spun[:, :mid] @ one)[:, :, None] + (spun[:, mid:] @ two)[:, None, :]
            for found, slack in ((expected, 0), (doubtful, 1e-5)):
                r, i, j = np.nonzero((score >= code.height * 2**0.5) if not slack else abs(score - code.height * 2**0.5) < slack)
                found |= set(zip(r.tolist(), ((k * code.words + i) * code.words + j).tolist()))
        given = list(zip(row.tolist(), direction.tolist()))
        assert given == sorted(given) and set(given) - doubtful == expected - doubtful and len(given) > 100, dim


def test_cap_recall_at_the_threshold():
    rng = np.random.default_rng(10)
    for dim in (2, 8, 24, 64, 256):
        x, g = rng.standard_normal((2, 1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g -= (g * x).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + (1 - 0.93**2) ** 0.5 * g / np.linalg.norm(g, axis=1, keepdims=True)
        for vectors in (1 << 9, 1 << 13):
            code = caps.Code(dim, vectors, caps.Caps())
            found = [set(zip(*(c.tolist() for c in code.filters(v)))) for v in (x, y)]
            assert len({row for row, _ in found[0] & found[1]}) >= 995, (dim, vectors)


def test_digest_is_of_the_set():
    a, b = (next(iter(wordsets.sets(pa.array([t]), 3))) for t in ("a b c d", "A  b c\nd"))
    assert wordsets.digest(a) == wordsets.digest(b) and len(hashlib.sha256(wordsets.digest(a)).digest()) == 32
