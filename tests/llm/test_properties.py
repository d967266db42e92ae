"""Round trips and equalities on generated texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import bpe, chat, html, simhash
from lakeloom.llm.queries import bpe_path
from tests.llm.test_simhash import slow_fingerprint

_PIECES = st.lists(st.sampled_from(["<", "|", "\\", "[", "]", "INST", "/", "s", ">", "<<SYS>>", "im_end", "\n", "n", "é", " "]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(_PIECES)
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    assert not any(mark in chat.escape(text) for mark in ("<|", "[INST]", "[/INST]", "<s>", "</s>"))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_bpe_round_trip(text):
    encoder = bpe.BlockEncoder(bpe.tokenizer(bpe_path()))
    (row,) = encoder.block([text])
    assert encoder.decoded(row) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "\t", " ", "\x1c", "z "]), max_size=60).map("".join))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<li>", "<ul>", "</ul>", "<", ">", "a ", "&amp;", "<!--", "-->", "<script>", "<b", "'", '"', "<article>", "</article>"]), max_size=40).map("".join))
def test_any_markup_is_read(source):
    tree = html.parse(source)
    assert all(block == block.strip() for block in html.content(tree, {}, frozenset()))
    assert len(html.align(tree, html.parse(source))) == sum(1 for _ in html.nodes(tree))
