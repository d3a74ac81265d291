import hashlib
import random

import pytest

from orrery.llm import chat


def test_folding_leaves_text():
    tree = chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 and not false %}c{% else %}{{ x }}{% endif %}{{ 'D' | lower }}"), chat.FILTERS)
    assert tree == (chat.Text("ab1cd"),)


def test_language():
    t = chat.Template("{% for m in messages -%}\n {{ loop.index0 }}{% if loop.first %}<{% elif m.role == 'x' or m['role'] in 'yz' %}={% else %}>{% endif %}{{ m.text | trim }}{% if loop.last %}.{% endif %}{% endfor %}")
    assert t.render([{"role": r, "text": f" {r} "} for r in "axzq"])[0] == "0<a1=x2=z3>q."
    for bad in ("{% for x %}{% endfor %}", "{% if a %}", "{{ a.b( }}", "{{ 'a' 'b' }}", "{{ x | evil }}", "{% import os %}", "{{ a.__class__.__mro__ }}{{ ( }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    assert chat.Template("{{ m.__class__ }}|{{ nothing.at.all }}").render([])[0] == "|"
    with pytest.raises(chat.TemplateError):
        chat.Template("{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}").render([])


def test_escape_is_reversible_and_hides_marks():
    rng = random.Random(1)
    t = chat.Template(chat.TURNS, chat.CONTROLS)
    for _ in range(300):
        said = [{"role": rng.choice(["user", "assistant", "<turn>", "\\"]), "text": "".join(rng.choices([*chat.CONTROLS, "\\", "\n", "<", "a", "é", "</turn>\n"], k=rng.randint(0, 8)))} for _ in range(rng.randint(0, 4))]
        text, spans = t.render(said)
        assert list(chat.read_turns(text)) == [(m["role"], m["text"]) for m in said]
        assert [chat.unescape(text[s:e]) for s, e in spans] == [m["text"] for m in said if m["role"] == "assistant" and m["text"]]


def test_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, "x"), (1, 1, "assistant", "a"), (2, None, "user", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 3 and got[1].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest() and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.digest_formatted(chat.format_conversations(df.limit(0))).isEmpty()


def test_a_long_conversation_streams():
    read = []

    def messages():
        for i in range(1000):
            read.append(i)
            yield {"role": "user", "text": "x" * 100}

    parts = chat.Template(chat.TURNS, chat.CONTROLS).stream(messages())
    next(parts)
    assert len(read) <= 2
