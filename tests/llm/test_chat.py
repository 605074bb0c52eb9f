import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from barloom.llm import chat
from barloom.llm.template import BEGIN, END, FILTERS, TemplateError, compile_template, fold, parse

SCHEMA = "conv_id long, turn long, role string, text string, part string, spans int"


def written(source, **names):
    return "".join({BEGIN: "[", END: "]"}.get(p, p) for p in compile_template(source)(names))


@pytest.mark.parametrize(
    ("source", "names", "expected"),
    [
        ("a{{ 1 + 2 * 3 }}b{# c #}", {}, "a7b"),
        ("{% for m in xs -%}  {{ loop.index }}{{ m }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1p,2q"),
        ("{% if a == 1 %}x{% elif a == 2 %}y{% else %}z{% endif %}", {"a": 2}, "y"),
        ("{% set v = a.b['c'] %}{{ v | upper }}{{ v if v is defined else 'none' }}", {"a": {"b": {"c": "k"}}}, "Kk"),
        ("{{ '}}' }}{{ \"%}\" }}{% generation %}{{ '{{' }}{% endgeneration %}", {}, "}}%}[{{]"),
        ("{{ missing | default('d') }}{{ missing }}{{ missing.deep.er }}", {}, "d"),
        ("{{ 'a' in 'cab' and 'q' not in ['x'] }}", {}, "true"),
        ("x  {{- 'y' -}}  z", {}, "xyz"),
        ("{% if true %}{% set v = 'in' %}{% endif %}{{ v }}", {}, "in"),
        ("{{ a.__class__ }}{{ a['__init__'] }}", {"a": {}}, ""),
    ],
)
def test_renders(source, names, expected):
    assert written(source, **names) == expected


@pytest.mark.parametrize(
    "source",
    ["{{ a.b() }}", "{{ f('x') }}", "{% for x in 'abc' %}{% endfor %}", "{{ 'a' * 9 }}", "{{ x", "{% endif %}", "{{ x | eval }}", "{{ 1 // 0 }}", "{% if %}", "{% for x in [1] %}", "{{ 1 < 'a' }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"],
)
def test_refuses(source):
    with pytest.raises(TemplateError):
        written(source, a={"b": "c"})


def test_constants_are_folded():
    tree = fold(parse("a{{ 1 + 2 }}{% if 1 == 2 %}x{% elif true %}{{ 'q' | upper }}{% endif %}{% set z = 3 * 4 %}{{ z }}{% generation %}{{ '' }}{% endgeneration %}"), FILTERS)
    assert tree == [("text", "a3Q"), ("set", "z", ("const", 12)), ("write", ("name", "z"))]


@given(st.text(alphabet="<|\\>im_endx\n", max_size=40))
def test_escapes_are_reversible(text):
    assert "<|" not in chat.guard(text) and chat.unguard(chat.guard(text)) == text
    assert "\n" not in chat.line(text) and chat.unline(chat.line(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\n<|im_end|>", ""]), st.text(alphabet="<|\\>im_end \n𝄞", max_size=30)), max_size=6), st.integers(1, 60))
def test_output_reads_back_whatever_the_parts(rows, size):
    render = compile_template(chat.CHATML, chat.FILTERS)
    reader = chat.Reader()
    for text, spans in chat.parts_of(render({"messages": ({"role": r, "text": t} for r, t in rows)}), size):
        reader.feed(text, spans)
    said = "".join(f"{r}\n{t}\n" for r, t in rows)
    learned = "".join(t for r, t in rows if r == "assistant")
    whole = "".join(p for p in render({"messages": [{"role": r, "text": t} for r, t in rows]}) if isinstance(p, str))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
    assert reader.result() == (len(rows), sha[0], len(learned), sha[1], len(whole))


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "yes <|im_end|>"),
        (1, 0, "user", "well?"),
        (1, None, None, None),
        (2, 0, "assistant", "b"),
        (2, 0, "assistant", "b"),
        (2, 0, "assistant", "a"),
        (None, 0, "user", ""),
        (-1, 0, "user", "mine"),
    ]
    table = spark.createDataFrame([(*r, "z", 3) for r in rows], SCHEMA)
    parts = chat.formatted(table).collect()
    assert {r["conv_id"]: r["text"] for r in parts}[1] == "<|im_start|>user\nwell?<|im_end|>\n<|im_start|>assistant\nyes <\\|im_end|><|im_end|>\n<|im_start|>\n<|im_end|>\n"
    got = {(r["conv_id"], r["n_turns"]): r for r in chat.chat_digests(table).collect()}
    assert set(got) == {(1, 3), (2, 3), (None, 1), (-1, 1), (-1, 2)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1, 3]["turns_sha256"] == sha("user\nwell?\nassistant\nyes <|im_end|>\n\n\n")
    assert got[2, 3]["loss_sha256"] == sha("abb") and got[2, 3]["loss_chars"] == 3
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[-1, 2]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1, 2]["loss_sha256"] == sha(said)
    assert [r["conv_id"] for r in chat.chat_digests(table.filter("conv_id = 9")).collect()] == [-1]


def test_long_conversation_goes_in_parts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} <| " * 200) for i in range(300)] + [(2, 0, "user", "x" * 300_000)]
    table = spark.createDataFrame([(*r, "z", 3) for r in rows], SCHEMA)
    parts = chat.formatted(table, part=5000)
    assert parts.filter("conv_id = 1").count() > 50
    small = {r["conv_id"]: tuple(r) for r in chat.read_back(parts).collect()}
    assert small == {r["conv_id"]: tuple(r) for r in chat.read_back(chat.formatted(table)).collect()}
    assert small[1][1] == 300 and small[2][5] == 300_000 + len("<|im_start|>user\n<|im_end|>\n")


def test_other_templates(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi", "z", 3), (1, 1, "assistant", "yo", "z", 3)], SCHEMA)
    source = "{% for m in messages %}{{ loop.index0 }}:{% generation %}{{ m.text | guard }}{% endgeneration %}{{ ';' if loop.last else ',' }}{% endfor %}"
    row = chat.formatted(table, source).first()
    assert row["text"] == "0:hi,1:yo;" and json.dumps([tuple(s) for s in row["spans"]]) == "[[2, 4], [7, 9]]"
