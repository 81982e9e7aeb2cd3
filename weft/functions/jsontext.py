"""Strict JSON: exact numbers, no duplicate keys, bounded depth; JSON Pointer get, set and remove.

Values are dicts, lists, strings, booleans, None and Number, which keeps a number's text. MISSING
stands for payload that isn't there, which differs from null.
"""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F

from ..model import MAX_WEIGHT_UNITS, GraphError

MAX_DEPTH = 128
class _Missing:
    def __repr__(self):
        return "MISSING"

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()


class Number(str):
    """A number as it was written."""

    __slots__ = ()


class _Pairs(list):
    """An object's members before duplicates are looked for."""


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def _settled(value, path: str, depth: int):
    if depth > MAX_DEPTH:
        raise GraphError("nesting_limit_exceeded", f"deeper than {MAX_DEPTH} at {path}", limit=MAX_DEPTH)
    if isinstance(value, _Pairs):
        out: dict = {}
        for k, v in value:
            _whole(k)
            here = f"{path}/{escape(k)}"
            if k in out:
                from ..model import Issue

                raise GraphError("duplicate_key", f"duplicate key at {here}", [Issue("duplicate_key", here)])
            out[k] = _settled(v, here, depth + 1)
        return out
    if isinstance(value, list):
        return [_settled(v, f"{path}/{i}", depth + 1) for i, v in enumerate(value)]
    if isinstance(value, str) and not isinstance(value, Number):
        _whole(value)
    return value


def _whole(text: str) -> None:
    if any("\ud800" <= c <= "\udfff" for c in text):
        raise GraphError("invalid_json", "a string holds half a surrogate pair")


def parse(text: str | bytes):
    """The value of a JSON text; GraphError invalid_json, duplicate_key or nesting_limit_exceeded."""

    def constant(name):
        raise ValueError(f"{name} is no JSON value")

    try:
        if isinstance(text, bytes):
            text = text.decode("utf-8")
        value = json.loads(text, object_pairs_hook=_Pairs, parse_int=Number, parse_float=Number, parse_constant=constant)
    except RecursionError:
        raise GraphError("nesting_limit_exceeded", f"deeper than {MAX_DEPTH}", limit=MAX_DEPTH) from None
    except ValueError as e:
        raise GraphError("invalid_json", str(e)) from None
    return _settled(value, "", 0)


def dump(value, pretty: bool = False, _indent: int = 0) -> str:
    """Compact or two-space JSON with keys in byte order and numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if value is None or isinstance(value, (bool, int)):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    inner = [(f"{json.dumps(k, ensure_ascii=False)}:{' ' if pretty else ''}", value[k]) for k in sorted(value, key=lambda k: k.encode())] if isinstance(value, dict) else [("", v) for v in value]
    left, right = "{}" if isinstance(value, dict) else "[]"
    if not inner:
        return left + right
    parts = [name + dump(v, pretty, _indent + 2) for name, v in inner]
    if not pretty:
        return left + ",".join(parts) + right
    pad = "\n" + " " * (_indent + 2)
    return left + pad + ("," + pad).join(parts) + "\n" + " " * _indent + right


# --- weights -------------------------------------------------------------------------------------


def weight_units(value) -> int:
    """Tenths of a weight: a JSON number, not negative, a multiple of 0.1, at most MAX_WEIGHT_UNITS tenths."""
    if not isinstance(value, Number):
        raise GraphError("invalid_weight", "a weight is a number")
    try:
        units = Decimal(value)
    except InvalidOperation:
        raise GraphError("invalid_weight", f"{value} is no weight") from None
    if not units.is_finite() or units.adjusted() > 17:
        raise GraphError("invalid_weight", f"{value} is out of range")
    sign, digits, exponent = units.as_tuple()
    # exact whatever the number of digits: shift the point by one and look for a fraction
    whole, exponent = int("".join(map(str, digits)) or "0"), exponent + 1
    if whole and exponent < 0:
        whole, rest = divmod(whole, 10 ** min(-exponent, len(digits) + 1))
        if rest:
            raise GraphError("invalid_weight", f"{value} is no multiple of 0.1")
    elif whole:
        whole *= 10**exponent
    if (sign and whole) or whole > MAX_WEIGHT_UNITS:
        raise GraphError("invalid_weight", f"{value} is out of range")
    return whole


def weight_text(units: int) -> str:
    return str(units // 10) + (f".{units % 10}" if units % 10 else "")


def weight_units_column(text):
    """Column form of weight_units over number texts (null: no valid weight); up to 18 fractional digits are looked at."""
    value = text.try_cast("decimal(38,18)")
    tenths = value * 10
    fine = (value >= 0) & (tenths % 1 == 0) & (tenths <= MAX_WEIGHT_UNITS)
    return F.when(fine, tenths.cast("bigint"))


def weight_text_column(units):
    return F.when(units % 10 == 0, (units / 10).cast("bigint").cast("string")).otherwise(F.concat(F.floor(units / 10).cast("string"), F.lit("."), (units % 10).cast("string")))


# --- pointers ------------------------------------------------------------------------------------


def pointer_tokens(pointer: str) -> list[str]:
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise GraphError("invalid_pointer", "a pointer is empty or begins with /")
    out = []
    for raw in pointer[1:].split("/"):
        if any(part[:1] not in ("0", "1") for part in raw.split("~")[1:]):
            raise GraphError("invalid_pointer", "~ is followed by 0 or 1")
        out.append(raw.replace("~1", "/").replace("~0", "~"))
    return out


def _index(token: str) -> int:
    if not (token.isascii() and token.isdigit()) or (len(token) > 1 and token[0] == "0"):
        raise GraphError("invalid_pointer", f"{token!r} is no array index")
    return int(token)


def pointer_get(data, pointer: str):
    """The value at a pointer; any step that leads nowhere is pointer_not_found."""
    if data is MISSING or data is None:
        if pointer == "":
            return None
        raise GraphError("pointer_type_mismatch", "the payload is null")
    at = data
    for token in pointer_tokens(pointer):
        if isinstance(at, dict) and token in at:
            at = at[token]
        elif isinstance(at, list) and token.isascii() and token.isdigit() and (token == "0" or token[0] != "0") and int(token) < len(at):
            at = at[int(token)]
        else:
            raise GraphError("pointer_not_found", pointer)
    return at


def _parent(data, tokens: list[str]):
    at = data
    for token in tokens[:-1]:
        if isinstance(at, dict):
            if token not in at:
                raise GraphError("pointer_not_found", token)
            at = at[token]
        elif isinstance(at, list):
            i = _index(token)
            if i >= len(at):
                raise GraphError("pointer_not_found", token)
            at = at[i]
        else:
            raise GraphError("pointer_type_mismatch", token)
    return at


def pointer_set(data, pointer: str, value):
    """data with the value put at a pointer: members are made or replaced, array items replaced, ``-`` appends."""
    tokens = pointer_tokens(pointer)
    if not tokens:
        return value
    if data is MISSING or data is None:
        raise GraphError("pointer_type_mismatch", "the payload is null")
    data = parse(dump(data))
    parent, last = _parent(data, tokens), tokens[-1]
    if isinstance(parent, dict):
        parent[last] = value
    elif isinstance(parent, list):
        if last == "-":
            parent.append(value)
        else:
            i = _index(last)
            if i >= len(parent):
                raise GraphError("pointer_not_found", pointer)
            parent[i] = value
    else:
        raise GraphError("pointer_type_mismatch", pointer)
    return data


def pointer_remove(data, pointer: str, ignore_missing: bool = False):
    """data without what a pointer names; the root's removal leaves MISSING. ignore_missing forgives absence only."""
    try:
        tokens = pointer_tokens(pointer)
        if not tokens:
            if data is MISSING:
                raise GraphError("pointer_not_found", pointer)
            return MISSING
        if data is MISSING or data is None:
            raise GraphError("pointer_type_mismatch", "the payload is null")
        data = parse(dump(data))
        parent, last = _parent(data, tokens), tokens[-1]
        if isinstance(parent, dict):
            if last not in parent:
                raise GraphError("pointer_not_found", pointer)
            del parent[last]
        elif isinstance(parent, list):
            i = _index(last)
            if i >= len(parent):
                raise GraphError("pointer_not_found", pointer)
            del parent[i]
        else:
            raise GraphError("pointer_type_mismatch", pointer)
        return data
    except GraphError as e:
        if ignore_missing and e.code == "pointer_not_found":
            return data
        raise


def from_column(text: str | None):
    return MISSING if text is None else parse(text)


def to_column(value) -> str | None:
    return None if value is MISSING else dump(value)


RESULT = "value string, error string"


def json_get(data, pointer: str):
    """Column struct (value, error): pointer_get over a column of JSON texts (null: no payload)."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return _each(texts, lambda v: dump(pointer_get(v, pointer)))

    return run(data)


def json_set(data, pointer: str, value: str):
    """Column struct (value, error): pointer_set of a JSON text."""
    new = parse(value)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return _each(texts, lambda v: to_column(pointer_set(v, pointer, new)))

    return run(data)


def json_remove(data, pointer: str, ignore_missing: bool = False):
    """Column struct (value, error): pointer_remove."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return _each(texts, lambda v: to_column(pointer_remove(v, pointer, ignore_missing)))

    return run(data)


def _each(texts: pd.Series, one) -> pd.DataFrame:
    values, errors = [], []
    for text in texts:
        try:
            values.append(one(from_column(text)))
            errors.append(None)
        except GraphError as e:
            values.append(None)
            errors.append(e.code)
    return pd.DataFrame({"value": values, "error": errors}, dtype=object)
