"""Column functions against values worked out by hand, and segmentation against a plain restatement."""

import random
import re

from pyspark.sql import functions as F

from gridweave.functions import scalars as S
from gridweave.functions import segmentation as G


def values(make, rows, column, schema="t string"):
    return [r[0] for r in make([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_parse_numeric(make):
    texts = ["1,234.5", "12%", "¥5", "1d", "NaN", "1_000", "", " 7 ", "-3.5e2", None, "$1,000", "abc"]
    assert values(make, texts, S.parse_numeric("t")) == [1234.5, 0.12, 5.0, None, None, None, None, 7.0, -350.0, None, 1000.0, None]


def test_blank_and_equal(make):
    assert values(make, ["0", "-", "n/a", "***", "待填", "x", None], S.is_empty_like("t")) == [False, True, True, True, True, False, True]
    pairs = [("-5", "5"), ("1.5", "15"), ("1,000", "1000"), ("A b", "a-B"), (None, None), ("x", None)]
    assert values(make, pairs, S.loose_equal("a", "b"), "a string, b string") == [False, False, True, True, True, False]
    assert values(make, [("5", "5.0"), ("A", "a "), (None, "x")], S.validation_equal("a", "b"), "a string, b string") == [True, True, False]


def test_addresses(make):
    assert values(make, [1, 26, 27, 702, 703, 18278], S.a1_encode(F.lit(3), F.col("t")), "t int") == ["A3", "Z3", "AA3", "ZZ3", "AAA3", "ZZZ3"]
    assert values(make, [1, 26, 27, 702, 703, 18278], S.a1_encode("3", "t"), "t int") == ["A3", "Z3", "AA3", "ZZ3", "AAA3", "ZZZ3"]
    assert values(make, ["A3", "ZZ10", "ZZZ1", "3A", "", "A"], S.a1_column("t")) == [1, 702, 18278, None, None, None]
    assert values(make, ["A3", "3A", ""], S.is_a1("t")) == [True, False, False]


def test_rounding_alias_flags(make):
    assert values(make, [0.12345, 2.0], S.round_for_display("t"), "t double") == [0.1234, 2.0]
    assert values(make, ["人数", "Cost", "other"], S.header_alias("t")) == ["employee", "amount", "other"]
    flags = make([("请撰写 ESG 报告",), ("ESG 报告大纲",), ("fill template",)], "t string").select(
        *[c.alias(n) for n, c in S.request_flags("t").items()]
    ).collect()
    assert [r["writes_report"] for r in flags] == [True, False, False] and flags[2]["fills_table"]
    assert values(make, ["平均和最大", "x"], S.operations_requested("t")) == [["avg", "max"], ["sum", "count"]]


def test_time_tokens(make):
    assert values(make, ["11月"], S.time_tokens("t")) == [["1月", "11月"]]
    assert values(make, ["11月"], S.time_tokens("t", longest_first=True)) == [["11月"]]


def test_lengths(make):
    got = values(make, ["1.5万字", "800-1200字", "写 5 字", "none"], S.length_requirement("t"))
    assert [tuple(r)[:4] for r in got] == [(True, 15000, 13500, 16500), (True, 1000, 800, 1200), (True, 300, 300, 420), (False, 3000, 2700, 3300)]
    assert values(make, ["# 你好 world-wide 3.5", None], S.word_count("t")) == [5, 0]


def test_number_units(make):
    text = "18,350 tCO2e, met 4 times"
    assert [tuple(n) for n in values(make, [text], S.number_units("t"))[0]] == [(18350.0, "tco2e"), (4.0, "次")]
    assert [tuple(n) for n in values(make, [text], S.number_units("t", compat=True))[0]] == [(18.0, ""), (350.0, "tco2e"), (4.0, "次")]


def test_merge_text(make):
    pairs = [("a line", "a  LINE"), ("a", "a\nb"), ("x\ny", "y\nz"), ("", "q"), ("q", None)]
    got = values(make, pairs, S.merge_text("a", "b", "more"), "a string, b string")
    assert got == ["a  LINE", "a\nb", "x\ny\n\n[more]\nz", "q", "q"]


def test_verdicts(make):
    texts = ['```json\n{"approved": false, "riskLevel": "HIGH", "issues": ["a", "a", " b "]}\n```', "no json", '{"riskLevel": "odd"}', '{"riskLevel": "high"}']
    got = values(make, texts, S.verdict("t"))
    assert [(r.status, r.approved, r.risk_level, r.block) for r in got] == [
        ("completed", False, "high", True), ("invalid_response", False, "unknown", True), ("completed", True, "medium", False), ("completed", False, "high", True),
    ]
    assert got[0].issues == ["a", "b"]


def test_pages(make):
    texts = ["[page 1]\nabc\n[第 2 页]\nxyz\n", "[page 1]\nabc", "plain"]
    assert values(make, texts, S.split_pages("t", 1, 2)) == [{1: "abc", 2: "xyz"}, {}, {}]
    assert values(make, ["plain", " "], S.split_pages("t", 3, 3)) == [{3: "plain"}, {}]


def test_types_and_words(make):
    names = ["a.PDF", "b.xlsx", "c.md", "d.csv", "e", ".md", "f.docx", "g.eml"]
    assert values(make, names, S.document_type("t")) == ["pdf", "excel", "note", "text", "other", "other", "word", "email"]
    assert values(make, ["A discount"], S.contains_any(F.lower("t"), ["count"])) == [True]
    assert values(make, ["A discount"], S.contains_any(F.lower("t"), ["count"], word=True)) == [False]
    assert values(make, ["请核对 anti-bribery 培训覆盖率 please"], G.request_keywords("t")) == [["请核", "核对", "请核对", "anti-bribery", "培训", "训覆", "覆盖", "盖率"]]


# A restatement of the segmentation in plain Python, for random texts.


def plain_segments(text, limit):
    def cut(block):
        if len(block) <= limit:
            return [block]
        parts = [p.strip() for p in re.split(r"(?<=[。！？!?；;])", block) if p.strip()]
        if len(parts) < 2:
            step = max(200, limit - 120)
            starts = range(0, max(len(block) - limit, 0) + step, step)
            slices = [block[s:s + limit].strip() for s in starts if s == 0 or s - step + limit < len(block)]
            return [piece for piece in slices if piece]
        done, line, size = [], None, 0
        for part in parts:
            if line is not None and size + len(part) + 1 > limit:
                done.append(line)
                line, size = part, len(part)
            else:
                line, size = part if line is None else f"{line} {part}", size + len(part) + 1
        return [*done, line]

    text = text.strip()
    for pattern in (r"\n\s*\n+", r"\n", r"(?<=[。！？!?；;])"):
        blocks = [b.strip() for b in re.split(pattern, text) if b.strip()]
        if len(blocks) > 1:
            break
    return [c for b in blocks for c in cut(b)] if text else []


def test_segments_like_plain_python(make):
    rng = random.Random(7)
    alphabet = "abc  de!?。;\n\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += ["x" * 1000, "y" * 950 + "! tail", "一。" * 300, "", " \n "]
    for limit in (40, 300):
        assert values(make, texts, G.segment_texts(F.col("t"), limit)) == [plain_segments(t, limit) for t in texts]
