"""Tokens, BPE, HTML, fingerprints: against the public libraries and plain versions."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from culvert.llm import bpe, html_render, simhash, substrings, token_counts

ODD = "ab  '  \n\t\r\x0b\x1c\x85　éß中😀٣²ⅫA'sll<|endoftext|><s>▁<0x0A>.tionthering"
TEXTS = ["", " ", "a", "Hello  world\n", "<|endoftext|>x <|endoftext|>", "a" * 3000, "x " * 500, "\x00", "1234567890" * 9, *["".join(random.Random(k).choices(ODD, k=k % 70)) for k in range(300)]]


def test_bpe_equals_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library, vocab = Tokenizer.from_file(path(bpe.MODEL)), bpe.vocabulary(bpe.MODEL)
    for text, packed in zip(TEXTS, bpe.encode(vocab, TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == want, text[:60]
        assert bpe.decode(vocab, ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_splits_every_character_like_the_library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library, vocab = Tokenizer.from_file(path(bpe.MODEL)), bpe.vocabulary(bpe.MODEL)
    texts = [" ".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 64)]
    for e, packed in zip(library.encode_batch(texts, add_special_tokens=False), bpe.encode(vocab, texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == e.ids


@given(st.text(alphabet="abnthe r.", min_size=257, max_size=600))
@settings(max_examples=20, deadline=None)
def test_long_pieces_take_the_same_merges(text):
    vocab, piece = bpe.vocabulary(bpe.MODEL), text.replace(" ", "x").encode()
    assert bpe.merge_long(vocab, piece).tolist() == bpe._merge(vocab, [piece], 1 << (len(piece) - 1).bit_length())[0].tolist()


def test_token_counts_equal_library_at_every_prefix():
    import sentencepiece
    from public_tokenizers import path

    library, table = sentencepiece.SentencePieceProcessor(model_file=path(token_counts.MODEL)), token_counts.prefixes(token_counts.MODEL)
    for text in TEXTS:
        assert table.total(text) == len(library.encode(text)), text[:60]
        if len(text) <= 70:
            want = [len(library.encode(text[:k])) for k in range(1, len(text) + 1)]
            assert table.counts(text) == want
            for budget in (0, 1, 3, 20):
                assert table.fit(text, budget) == max((k for k, n in enumerate(want, 1) if n <= budget), default=0)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(1, 25))
@settings(deadline=None)
def test_window_hashes_depend_on_the_window_alone(words, width):
    hashes = substrings.window_hashes(np.array(words, np.uint64), width)
    assert len(hashes) == max(0, len(words) - width + 1)
    for k, h in enumerate(hashes):
        assert substrings.window_hashes(np.array(words[k : k + width], np.uint64), width)[0] == h


def test_intervals_are_maximal():
    assert substrings.intervals(np.array([3, 0, 5, 30]), 5) == [(0, 10), (30, 35)]
    assert substrings.intervals(np.array([0, 5]), 5) == [(0, 10)]
    assert substrings.without(b" a b\n c d ", [(0, 2)]) == b"c d "
    assert substrings.without(b"a b\n c d ", [(1, 3)]) == b"a d "


def test_fingerprint_equals_plain_version():
    for text in [*TEXTS, "The THE the the", "one two", "Äh Ä ä"]:
        assert int(simhash.fingerprints(text.encode())[0]) == brute.fingerprint(text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("<", "<"), ("a < b <3", "a < b <3"), ("<p>a<p>b", "a\n\nb"), ("x<br>y<br/>z", "x\ny\nz"),
        ("<ul><li>a<li>b <ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
        ("<style>.x,#y{display:none}</style><p class=x>no<p id=y>no<div hidden>no</div><p style='visibility: hidden'>no<p>yes", "yes"),
        ("<head><title>t</title><script>var a='</p>';</script></head>b <!-- c -->d", "b d"),
        ("<table><tr><th>Name<th>N<tr><td>long one<td>1<tr><td rowspan=2>r<td>2<tr><td>3</table>", "Name      N\nlong one  1\nr         2\n          3"),
        ("<pre>  a\n   b</pre>&amp;&copy;", "  a\n   b\n\n&©"), ("<b>a</i></b><div>c</div></p>d", "a\nc\n\nd"),
        ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n  d\n\n  q"), ("<details><summary>s</summary>no</details>", "s"),
        ("<select><option>a<option selected>b</select>", "b"), ("<div>" * 3000 + "x", "x"), ("<table><tr><td>" * 300 + "deep", "deep"),
    ],
)
def test_rendering(page, text):
    assert html_render.render(page) == text
