"""The field reads every token of a text, whatever stands beside it."""

import random

import pytest

from helixframe.llm import secrets as S
from tests.llm.test_secrets import CASES, LEADS, SECRETS, documents, planted


@pytest.fixture(scope="module")
def field():
    return S.train()


def plain(text, field):
    """Viterbi on all tokens of the text as one chain."""
    parts, out = S.tokens(text, 0, len(text)), []
    if not parts:
        return out
    tags = field.decode([field.places(f) for f in S.chain_features(text, parts, S.file_features(text))])
    for (s, e), tag in zip(parts, tags, strict=True):
        if tag == S.B:
            out.append((s, e))
        elif tag == S.I:
            out[-1] = (out[-1][0], e)
    return out


def test_tags_are_those_of_all_tokens(field):
    rng, docs = random.Random(12), documents("sf0.001")
    texts = [*docs, *(t or "" for t in CASES if len(t or "") < 5000)]
    for kind in SECRETS.values():
        texts += [planted(rng, docs, rng.choice((*LEADS, "", "", "and then ", "x\n\ny: ")), kind(rng))[0] for _ in range(25)]
    texts += ["key pin is was is AbC1234! " * 30, "paſsword: hunter2! \n\n= : =\n is it", "  \n", "…", "a=b==c=", "'`\"", "Größe: x.y.. z…"]
    assert [S.crf_spans(t, field) for t in texts] == [plain(t, field) for t in texts]


def test_tokens_far_from_clues_and_without_digits_are_read(field):
    """No clue word, no mix of letters and digits and no address is near: these tokens weren't looked at."""
    rng = random.Random(3)
    texts = ["lorem ipsum dolor sit amet " * 40 + "".join(rng.choices(c, k=n)) + " consectetur elit" * 40 for c, n in (("0123456789", 24), ("BCDFGHJKLMNPQRSTVWXZ", 36)) for _ in range(20)]
    found = [S.crf_spans(t, field) for t in texts]
    assert found == [plain(t, field) for t in texts]
    assert any(found)


def test_kept_texts_of_tokens_are_bounded(field, monkeypatch):
    monkeypatch.setattr(S.Bounds, "KEPT", 50)
    docs = documents("sf0.001")[:30]
    assert [S.crf_spans(t, field) for t in docs] == [plain(t, field) for t in docs]
    assert len(field.bounds.ids) < 50 + max(len(S.tokens(t, 0, len(t))) for t in docs) + 2


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab1 \n=:,;\"'`()<>[]{}|.…\x85\u3000é😀", k=rng.randint(0, 30))) for _ in range(5000)]
    for t in texts:
        assert S.tokens(t, 0, len(t)) == [S._stripped(t, *m.span()) for m in S.TOKEN.finditer(t)]
