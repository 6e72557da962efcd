"""JSON out of the text of a model's answer.

``extracted`` takes the first of the tiers that gives a value, over Arrow batches, as JSON text, which Spark parses as
Variant; all that follows is Variant expressions. One scanner with a bracket stack and string state does all repairs.

Nothing throws: texts that are null, empty or hopeless give nulls, and so does nesting beyond Python's limit.
"""

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand before a bare value, in the order in which they are tried.
PREFIXES = ["Here is", "Here's", "Below is", "The following", "json\n", "JSON\n"]
FENCED = re.compile(r"```(?:json)?\s*\n?(.*?)\n?```", re.DOTALL)
FENCE = re.compile(r"```(?:json)?\s*\n?")
TOKEN = re.compile(r'\s+|"(?:[^"\\]|\\.)*"|(?P<open>"(?:[^"\\]|\\.)*\\?\Z)|[{}\[\],:]|[^\s{}\[\],:"]+', re.DOTALL)
ATOM = re.compile(r"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\Z")
CONTROL = re.compile(r"[\x00-\x1f]")
CLOSER = {"{": "}", "[": "]"}


class Scan:
    """A value read from the start of a text as far as it is JSON, with the commas before closing brackets left out and
    control characters in strings escaped. ``whole``: it ended; ``cut_off``: the text ended within it."""

    def __init__(self, text: str, close_strings: bool = False):
        self.out: list[str] = []
        self.stack: list[str] = []
        self.closed = self.valued = None  # how much of out ends with a container, with a value, and the stack there
        self.whole = self.cut_off = False
        expect, at = "value", 0
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found:
                return
            token, at = found[0], found.end()
            if token.isspace():
                continue
            if found["open"] is not None:
                if not close_strings or expect not in ("value", "value or end"):
                    break  # the rest of the text
                token = re.sub(r"\\\Z", "", token) + '"'
                found = None
            expect = self._take(token, expect)
            if expect is None:
                return
            if self.whole:
                self.rest = text[at:]
                return
            if found is None:
                break
        self.cut_off = bool(self.stack)

    def _take(self, token: str, expect: str) -> str | None:
        """Puts a token out; what may follow, or None if it can't stand here."""
        wants_value = expect in ("value", "value or end")
        if token in "{[" and wants_value:
            self.out.append(token)
            self.stack.append(token)
            return "key or end" if token == "{" else "value or end"
        if token in "}]":
            after_comma = bool(self.out) and self.out[-1] == "," and expect in ("key", "value")
            if not self.stack or CLOSER[self.stack[-1]] != token or not (after_comma or expect.endswith("end")):
                return None
            if after_comma:
                self.out.pop()
            self.out.append(token)
            self.stack.pop()
            self.closed = len(self.out), list(self.stack)
            return self._value()
        if token == ",":
            if expect != "comma or end":
                return None
            self.out.append(token)
            return "key" if self.stack[-1] == "{" else "value"
        if token == ":":
            self.out.append(token)
            return "value" if expect == "colon" else None
        if token[0] == '"':
            self.out.append(CONTROL.sub(lambda m: f"\\u{ord(m[0]):04x}", token))
            return "colon" if expect in ("key", "key or end") else self._value() if wants_value else None
        if wants_value and ATOM.match(token):
            self.out.append(token)
            return self._value()
        return None

    def _value(self) -> str:
        self.valued = len(self.out), list(self.stack)
        self.whole = not self.stack
        return "comma or end"

    def ended_at(self, place) -> str | None:
        """The text up to a place, with its open containers closed."""
        if place is None:
            return None
        n, stack = place
        return "".join(self.out[:n]) + "".join(CLOSER[b] for b in reversed(stack))


def _loaded(text: str):
    """JSON text of a value, or None; numbers that JSON doesn't have become null, and of equal keys the last counts."""
    try:
        return json.dumps(json.loads(text, parse_constant=lambda _: None))
    except (ValueError, RecursionError):
        return None


def without_end(text: str) -> str | None:
    """A value that the text's end cuts off, up to its last closed container, or else its last whole value."""
    s = Scan(text.strip().rstrip(","))
    return _loaded(s.ended_at(s.closed or s.valued) or "") if s.cut_off else None


def repaired(text: str) -> str | None:
    """A value out of anything: fences and what stands before the first bracket go, also commas before closing brackets;
    strings and containers that the text's end leaves open are closed. What can't be read ends it at its last container."""
    text = re.sub(r"```(?:json)?\s*", "", text)
    at = re.search(r"[{\[]", text)
    if not at:
        return None
    s = Scan(text[at.start() :], close_strings=True)
    return _loaded(s.ended_at(s.valued if s.whole or s.cut_off else s.closed or s.valued) or "")


def tiers(text: str):
    """(tier, JSON text or None) in the order in which they are tried."""
    text = text.strip()
    yield "direct", _loaded(text)
    if fenced := FENCED.search(text):
        yield "fenced", _loaded(fenced[1].strip())
        yield "fenced, repaired", repaired(fenced[1])
    elif fence := FENCE.search(text):
        body = text[fence.end() :]
        yield "fence without end", without_end(body)
        yield "fence without end, repaired", repaired(body)
    for name, first, last in (("object", "{", "}"), ("array", "[", "]")):
        at, end = text.find(first), text.rfind(last)
        if at >= 0:
            yield name, _loaded(text[at : end + 1]) if end > at else None
            yield f"{name} without end", without_end(text[at:])
    for prefix in PREFIXES:
        at = text.lower().find(prefix.lower())
        if at >= 0:
            yield "prefix", _loaded(text[at + len(prefix) :].strip())
    yield "repaired", repaired(text)


def extract(text: str | None) -> tuple[str | None, str | None]:
    """The first tier that gives a value, and the value as JSON text."""
    return next(((name, value) for name, value in tiers(text or "") if value is not None), (None, None))


def extracted(text: Column) -> Column:
    """Struct (tier, json) of a text; nulls where no tier gives a value."""

    @F.pandas_udf("tier string, json string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(t) for t in texts], columns=["tier", "json"])

    return run(text)


def parsed(json_text: Column) -> Column:
    return F.try_parse_json(json_text)


def items(value: Column, *keys: str) -> Column:
    """The list of a Variant: itself, or under the first of the keys that holds a list; a single object is a list of one."""
    lists = [F.try_variant_get(value, f"$.{k}", "array<variant>") for k in keys]
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), *lists, F.when(is_object, F.array(value)), F.array().cast("array<variant>"))


def text_under(value: Column, *keys: str) -> Column:
    """The first text that isn't empty under one of the keys."""
    texts = [F.try_variant_get(value, f"$.{k}", "string") for k in keys]
    return F.coalesce(*(F.when(t != "", t) for t in texts))


def continuation(value: Column) -> Column:
    """The id of the last item where the value, or its last item, says that more is to come; else null."""
    more = lambda v: F.try_variant_get(v, "$.status", "string") == "to_be_continued"
    number = lambda v, key: F.try_variant_get(v, f"$.{key}", "long")
    list_of = F.try_variant_get(value, "$.items", "array<variant>")
    last = F.when(F.size(list_of) > 0, F.element_at(list_of, -1))
    own = F.when(more(value), F.coalesce(number(value, "last_item_id"), F.lit(0)))
    return F.coalesce(own, F.when(more(last), F.coalesce(number(last, "last_item_id"), number(last, "id"), F.size(list_of))))
