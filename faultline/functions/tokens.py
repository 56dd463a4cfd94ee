"""Tokens of SQL text as column expressions.

A text is cut into tokens, each with the blanks and comments behind it, so that joining them
gives the text back. A token is a string (also between dollar signs), a template expression, a name
with its qualifiers, a number or one other character. Strings, templates and comments that
never close reach to the end. Edits touch tokens, so what stands in strings and comments is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|\{#(?:[^#]++|#(?!\}))*+(?:#\}|\z)"
_REMARK = rf"{_BLOCK}|--[^\n]*+"
_TRIVIA = rf"(?:\s++|{_REMARK})"
_STRING = r"'[^']*+(?:'|\z)|\$(?<tag>\w*+)\$[\s\S]*?(?:\$\k<tag>\$|\z)"
_TEMPLATE = r"\{\{(?:[^}]++|\}(?!\}))*+(?:\}\}|\z)|\{%(?:[^%]++|%(?!\}))*+(?:%\}|\z)"
_PART = r"(?:[\p{L}_][\p{L}\p{N}_$]*+|\"[^\"]*+(?:\"|\z)|`[^`]*+(?:`|\z))"
_NAME = rf"{_PART}(?:\.{_PART})*+"
_NUMBER = r"\d[\p{L}\p{N}_.]*+"
_TOKEN = rf"(?:{_STRING}|{_TEMPLATE}|{_NAME}|{_NUMBER}|[\s\S])"
# Blanks and comments before the first token are a piece of their own.
PIECE = rf"\A{_TRIVIA}++|{_TOKEN}{_TRIVIA}*+"

# Words that do not name a column where an operand may stand (fixed values).
NOT_COLUMNS = ("case", "interval", "null", "not", "all", "any", "array", "row", "select", "distinct", "true", "false")
# Noncharacters that mark places while a text is edited.
CHANGED, LINE_END = "﷐", "﷑"


def pieces(text: Column) -> Column:
    """The tokens of a text with what stands behind them."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def token(piece: Column) -> Column:
    """A piece without the blanks and comments; empty for those before the first token."""
    return F.regexp_extract(piece, rf"\A(?!{_TRIVIA})({_TOKEN})", 1)


def is_name(sign: Column) -> Column:
    return F.rlike(sign, F.lit(r'\A[\p{L}_"`]')) & ~F.lower(sign).isin(*NOT_COLUMNS)


def _ends_operand(sign: Column) -> Column:
    return F.rlike(sign, F.lit(r"""\A(?:[\p{L}\p{N}_"`'$)\]]|\{\{)""")) & ~F.lower(sign).isin("select", "distinct", "case", "when", "then", "else")


def _at(items: str, i: Column) -> Column:
    return F.coalesce(F.get(items, i), F.lit(""))


def _with(rows, **columns):
    """``rows`` with more columns, each computed once: a plain projection would be copied into every use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _divides(i: Column) -> Column:
    """Whether token ``i`` is a division: a single slash behind an operand."""
    return (_at("_signs", i) == "/") & (_at("_signs", i + 1) != "/") & F.coalesce(F.get("_ends", i - 1), F.lit(False))


def _names_divisor(sign: Column, i: Column) -> Column:
    """Whether token ``i`` is a whole divisor that names a column: no call, element, or part of a longer word."""
    after = _at("_signs", i + 1)
    glued = (F.get("_pieces", i) == sign) & F.startswith(after, F.lit("{"))
    return F.coalesce(F.get("_slash", i - 1), F.lit(False)) & is_name(sign) & ~F.rlike(after, F.lit(r"\A['(\[.$]")) & ~glued


def _bracket_divisors() -> Column:
    """First and last token of every divisor in brackets that names a column, as (``open``, ``close``)."""

    def close(start: Column) -> Column:
        def walk(state: Column, b: Column) -> Column:
            depth = state["depth"] + b["step"]
            done = (b["at"] < start) | (state["close"] >= 0)
            return F.when(done, state).otherwise(
                F.struct(depth.alias("depth"), F.when(depth == 0, b["at"]).otherwise(-1).alias("close"))
            )

        return F.aggregate(
            "_brackets", F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("close")), walk, lambda state: state["close"]
        )

    def names_column(pair: Column) -> Column:
        inner = F.slice("_signs", pair["open"] + 2, F.greatest(pair["close"] - pair["open"] - 1, F.lit(0)))
        return (pair["close"] > pair["open"]) & F.exists(inner, is_name)

    opens = F.filter("_brackets", lambda b: (b["step"] == 1) & F.coalesce(F.get("_slash", b["at"] - 1), F.lit(False)))
    pairs = F.transform(opens, lambda b: F.struct(b["at"].alias("open"), close(b["at"]).alias("close")))
    return F.filter(pairs, names_column)


def with_divisors(rows, text: str):
    """``rows`` with the tokens of a text, and which of them are divisors that name a column.

    ``_pieces`` and ``_signs`` hold the tokens with and without what stands behind, ``_named`` whether a
    token is such a divisor by itself, ``_pairs`` the first and last token of those in brackets.
    """
    cut = _with(rows, _pieces=pieces(F.col(text)))
    cut = _with(cut, _signs=F.transform("_pieces", token))
    cut = _with(cut, _ends=F.transform("_signs", _ends_operand))
    cut = _with(
        cut,
        _slash=F.transform("_signs", lambda s, i: _divides(i)),
        _brackets=F.filter(
            F.transform(
                "_signs",
                lambda s, i: F.struct(i.alias("at"), F.when(s == "(", 1).when(s == ")", -1).otherwise(0).alias("step")),
            ),
            lambda b: b["step"] != 0,
        ),
    )
    return _with(cut, _named=F.transform("_signs", _names_divisor), _pairs=_bracket_divisors()).drop("_ends", "_slash", "_brackets")


def guard_divisors(rows, text: str, into: str, note: str):
    """``rows`` with the text ``into`` in which divisors that name columns stand in ``NULLIF(..., 0)``.

    Blanks around the slash become one. ``note`` ends every changed line, where the line ends outside of strings and
    comments. Guarded divisors are calls, so a second run changes nothing. A text that holds one of the two noncharacters
    used as marks stays as it is.
    """
    cut = with_divisors(rows, text)
    cut = _with(
        cut,
        # 1: named, 2: a bracket opens, 3: a bracket closes.
        _edit=F.transform(
            "_named",
            lambda named, i: F.when(named, 1)
            .when(F.exists("_pairs", lambda b: b["open"] == i), 2)
            .when(F.exists("_pairs", lambda b: b["close"] == i), 3)
            .otherwise(0),
        ),
    )

    def edited(piece: Column, i: Column) -> Column:
        sign, edit = F.get("_signs", i), F.get("_edit", i)
        behind = F.substr(piece, F.length(sign) + 1)
        # Around the slash of a guarded divisor.
        near = F.get("_edit", i + 1).isin(1, 2) | (F.get("_edit", i + 2).isin(1, 2) & (F.get("_signs", i + 1) == "/"))
        behind = F.when(F.coalesce(near, F.lit(False)) & F.rlike(behind, F.lit(r"\A[ \t]*\z")), F.lit(" ")).when(
            F.contains(behind, F.lit("\n")),
            # Ends of lines outside of comments are marked.
            F.regexp_replace(behind, rf"\G((?:{_REMARK}|[^\n])*+)\n", f"$1{LINE_END}\n"),
        ).otherwise(behind)
        return F.concat(
            F.when(edit.isin(1, 2), F.lit(CHANGED + "NULLIF(")).otherwise(""),
            sign,
            F.when(edit.isin(1, 3), F.lit(", 0)")).otherwise(""),
            behind,
        )

    cut = _with(cut, _lines=F.split(F.array_join(F.transform("_pieces", edited), ""), LINE_END))

    def noted(line: Column, i: Column) -> Column:
        bare = F.concat(F.regexp_replace(F.replace(line, F.lit(CHANGED), F.lit("")), r"\s+\z", ""), F.lit(note))
        ended = F.when(i == F.size("_lines") - 1, F.concat(bare, F.lit("\n"))).otherwise(bare)
        return F.when(F.contains(line, F.lit(CHANGED)), ended).otherwise(line)

    marked = F.contains(text, F.lit(CHANGED)) | F.contains(text, F.lit(LINE_END))
    edits = F.exists("_edit", lambda e: e > 0)
    done = F.when(edits & ~marked, F.array_join(F.transform("_lines", noted), "")).otherwise(F.col(text))
    return cut.withColumn(into, done).drop("_pieces", "_signs", "_named", "_pairs", "_edit", "_lines")


def divisions() -> Column:
    """From the columns of ``with_divisors``, every division by a column: (``line_no``, ``numerator``, ``denominator``).

    Brackets are given as ``(...)``.
    """

    def operand(i: Column, bracket: str) -> Column:
        return F.when(F.get("_signs", i) == bracket, "(...)").otherwise(F.get("_signs", i))

    def step(state: Column, i: Column) -> Column:
        here = F.struct(
            state["line"].alias("line_no"), operand(i - 1, ")").alias("numerator"), operand(i + 1, "(").alias("denominator")
        )
        hit = F.coalesce(F.get("_named", i + 1), F.lit(False)) | F.exists("_pairs", lambda b: b["open"] == i + 1)
        piece = F.get("_pieces", i)
        ends = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        return F.struct(
            (state["line"] + ends).alias("line"), F.when(hit, F.array_append(state["out"], here)).otherwise(state["out"]).alias("out")
        )

    empty = F.array().cast("array<struct<line_no:int,numerator:string,denominator:string>>")
    every = F.transform("_pieces", lambda piece, i: i)
    return F.aggregate(every, F.struct(F.lit(1).alias("line"), empty.alias("out")), step, lambda state: state["out"])
