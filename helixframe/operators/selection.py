"""The atom selection language, compiled to a column predicate that Spark can push down.

expression := term ("or" term)*; term := factor ("and" factor)*; factor := "not" factor | "(" expression ")" | test
test := name V | chain V | resname V | resid N | resid A-B | element V | a group | an atom name
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residue names of protein and water, and backbone atom names.
PROTEIN = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE SEC PYL".split()
WATER = "HOH WAT H2O DOD TIP3 SOL".split()
BACKBONE = "N CA C O".split()


class SelectionError(ValueError):
    pass


def _tokens(query: str) -> list[str]:
    return query.replace("(", " ( ").replace(")", " ) ").split()


def _groups(cols: dict[str, Column]) -> dict[str, Column]:
    name, residue, element = F.trim(cols["atom_name"]), F.trim(cols["residue_name"]), F.trim(F.coalesce(cols["element"], F.lit("")))
    backbone, hydrogen = name.isin(BACKBONE), element.isin("H", "D")
    return {
        "backbone": backbone, "sidechain": ~backbone & (element != "H"), "protein": residue.isin(PROTEIN), "water": residue.isin(WATER),
        "hetero": ~residue.isin(PROTEIN + WATER), "hydrogen": hydrogen, "heavy": ~hydrogen, "all": F.lit(True),
    }


def _number(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise SelectionError(f"not a residue number: {text!r}") from None


def select(query: str, columns: dict[str, str] | None = None) -> Column:
    """Predicate of a query over the columns of the atom table; an empty query selects everything.

    columns renames them. A negative residue number can't be written: a minus sign always makes a range.
    """
    names = {c: c for c in ("atom_name", "chain_id", "residue_name", "residue_serial", "element")} | (columns or {})
    cols = {k: F.col(v) for k, v in names.items()}
    groups, tokens, at = _groups(cols), _tokens(query), 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise SelectionError(f"unexpected end of {query!r}")
        at += 1
        return tokens[at - 1]

    def joined(part, word: str, how) -> Column:
        out = part()
        while (peek() or "").lower() == word:
            take()
            out = how(out, part())
        return out

    def either() -> Column:
        return joined(both, "or", lambda a, b: a | b)

    def both() -> Column:
        return joined(single, "and", lambda a, b: a & b)

    def single() -> Column:
        token = take()
        word = token.lower()
        if word == "not":
            return ~single()
        if word == "(":
            out = either()
            if take() != ")":
                raise SelectionError(f"no closing parenthesis in {query!r}")
            return out
        if word in groups:
            return groups[word]
        if word == "resid":
            value = take()
            if "-" in value:
                low, high = value.split("-", 1)
                return cols["residue_serial"].between(_number(low), _number(high))
            return cols["residue_serial"] == _number(value)
        plain = {"name": "atom_name", "chain": "chain_id", "resname": "residue_name", "element": "element"}
        if word in plain:
            value = take()
            return F.trim(cols[plain[word]]) == (value.upper() if word == "resname" else value)
        if word in (")", "and", "or"):
            raise SelectionError(f"unexpected {token!r} in {query!r}")
        return F.trim(cols["atom_name"]) == token

    if not tokens:
        return F.lit(True)
    out = either()
    if at < len(tokens):
        raise SelectionError(f"unexpected {tokens[at]!r} in {query!r}")
    return F.coalesce(out, F.lit(False))
