"""JSON values (VARIANT columns) against shapes: every problem as a path with a message, values read out, and canonical text.

A shape is a tree of the classes below. Nothing is converted: a number in quotes is no number, true is no whole number, 1.0 is none either.
Everything is built-in functions, so a value is judged within its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Messages of problems, as a correction repeats them to a model.
REQUIRED, EXTRA = "Field required", "Extra inputs are not permitted"
NO_FLAG, NO_WHOLE, NO_NUMBER, NO_FINITE, NO_TEXT, NO_LIST, NO_RECORD = (f"Input should be {x}" for x in ("a valid boolean", "a valid integer", "a valid number", "a finite number", "a valid string", "a valid list", "an object"))
BLANK = "Value error, must not be blank"
# End of the fixed values.

_STRINGS = "array<string>"


@dataclass(frozen=True)
class Shape:
    nullable: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class Flag(Shape):
    """true or false."""


@dataclass(frozen=True)
class Whole(Shape):
    """A whole number that fits a long, within bounds."""

    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Number(Shape):
    """A finite number."""


@dataclass(frozen=True)
class Text(Shape):
    """A string of so many characters that passes tests: (function of its column, message), the first failed one counts."""

    least: int = 0
    most: int | None = None
    tests: tuple[tuple[Callable[[Column], Column], str], ...] = ()


@dataclass(frozen=True)
class Many(Shape):
    """A list of items of one shape."""

    item: Shape
    least: int = 0
    most: int | None = None


@dataclass(frozen=True)
class Record(Shape):
    """An object. closed: it has no other keys; optional: keys that may be absent; rules: tests of the whole, once every field is right."""

    fields: dict[str, Shape]
    closed: bool = False
    optional: tuple[str, ...] = ()
    rules: tuple[tuple[Callable[[Column], Column], str], ...] = ()


def filled(most: int, *tests: tuple[Callable[[Column], Column], str], nullable: bool = False) -> Text:
    """A string that is neither empty nor blank."""
    return Text(1, most, ((lambda s: s.rlike(r"(?U)\S"), BLANK), *tests), nullable=nullable)


def strict_json(text: Column) -> Column:
    """The one JSON value that a text consists of, or null. What stands behind a value, which the parser would pass over, is looked at too: the text is
    set into a list with a mark behind it. Keys that are there twice make it null."""
    mark = F.xxhash64(text).cast("string")
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]")))

    def alone(w: Column) -> Column:
        two = (F.try_variant_get(w, "$[1]", "string") == mark) & F.try_variant_get(w, "$[2]", "variant").isNull()
        return F.when(two, F.try_variant_get(w, "$[0]", "variant"))

    return let(whole, alone)


def kind_of(value: Column) -> Column:
    """VOID, BOOLEAN, STRING, BIGINT, DECIMAL(..), DOUBLE, ARRAY<..> or OBJECT<..>; null for a value that is not there."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """Whether a value is an object, without working out the kind of all that it holds."""
    return F.try_variant_get(value, "$", "struct<_:boolean>").isNotNull()


def _is_whole(kind: Column) -> Column:
    # a decimal without a fraction that a long could hold was written with one
    return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$")


def child(value: Column, path: str, kind: str = "variant") -> Column:
    if not path and kind == "variant":
        return value
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def items(value: Column) -> Column:
    """The items of a list as variants; null if it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _under(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def problems(value: Column, shape: Shape) -> Column:
    """Array of `path: message` for everything in which a value departs from its shape, in the shape's order. The whole's own path is root.

    Records are walked while the expression is made, so that a field is one CASE over its path; only items of lists are walked in the row.
    """
    found = _parts(value, "", shape, None, F.lit(True))
    rules = shape.rules if isinstance(shape, Record) else ()
    if not rules:
        return found
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(_one(_first([(test(value), f"Value error, {message}") for test, message in rules]), F.lit("root: "))))


def _one(message: Column, lead: Column) -> Column:
    return F.array_compact(F.array(F.concat(lead, message)))


def _first(tests: list[tuple[Column, str]]) -> Column:
    """The message of the first test that is not true, or null."""
    out = None
    for ok, message in tests:
        wrong = ~F.coalesce(ok, F.lit(False))
        out = F.when(wrong, F.lit(message)) if out is None else out.when(wrong, F.lit(message))
    return F.lit(None).cast("string") if out is None else out


def _parts(root: Column, path: str, shape: Shape, lead: Column | None, guard: Column) -> Column:
    """Problems of what stands at a path below root. lead: the path of root itself; guard: whether what is above is right."""
    plain: list[Column] = []
    out: list[Column] = []

    def flush() -> None:
        if plain:
            out.append(F.array_compact(F.array(*plain)))
            plain.clear()

    def label(at: str) -> Column:
        return F.lit(at or "root") if lead is None else F.concat(lead, F.lit(f".{at}")) if at else lead

    def walk(at: str, own: Shape, ok: Column, required: bool, below: Column | None = None) -> None:
        v = child(root, at)
        kind, said = kind_of(v), lambda m: F.concat(label(at), F.lit(": "), F.lit(m) if isinstance(m, str) else m)
        is_there = lambda v, kind: v.isNotNull() if not own.nullable else v.isNotNull() & (kind != "VOID")

        def case_of(v: Column, kind: Column) -> Column:
            case = F.when(~ok, None) if not required else F.when(~ok, None).when(v.isNull(), said(REQUIRED))
            return case.when(~is_there(v, kind), None)

        if isinstance(own, Record):
            right = _is_record(root, at, own)
            plain.append(case_of(v, kind).when(~right, said(NO_RECORD)))
            below = ok & is_there(v, kind) & right if below is None else below
            for name, inner in own.fields.items():
                walk(_under(at, name), inner, below, name not in own.optional)
            if own.closed:
                flush()
                other = F.filter(F.map_keys(child(root, at, "map<string,variant>")), lambda k: ~k.isin(*own.fields))
                where = label(at) if at or lead is not None else None
                named = lambda k: F.concat(*([where, F.lit(".")] if where is not None else []), k, F.lit(f": {EXTRA}"))
                out.append(F.when(below, F.transform(other, named)).otherwise(_none()))
        elif isinstance(own, Many):
            flush()

            def listed(x: Column, found: Column) -> Column:
                case = case_of(x, kind_of(x)).when(found.isNull(), said(NO_LIST))
                right = ok & is_there(x, kind_of(x)) & found.isNotNull()
                return _many(found, own, label(at), F.array_compact(F.array(case)), right)

            out.append(let(v, lambda x: let(items(x), lambda found: listed(x, found))))
        else:
            # a field is read out once, and its kind is worked out once
            told = lambda f: case_of(f["v"], f["kind"]).otherwise(F.concat(label(at), F.lit(": "), _leaf(f["v"], "", f["kind"], own)))
            plain.append(let(v, lambda x: let(F.struct(x.alias("v"), kind_of(x).alias("kind")), told)))

    def whole(below: Column | None = None) -> Column:
        walk(path, shape, guard, True, below)
        flush()
        return F.concat(*out) if len(out) > 1 else out[0]

    if not isinstance(shape, Record) or path:
        return whole()
    # whether the whole is a record is looked at once, not once a field
    there = root.isNotNull() & (kind_of(root) != "VOID") if shape.nullable else root.isNotNull()
    return let(guard & there & _is_record(root, path, shape), whole)


def _some(root: Column, at: str, shape: Record) -> Column:
    """Whether any of a record's own fields is there."""
    return reduce(or_, [child(root, _under(at, name)).isNotNull() for name in shape.fields], F.lit(False))


def _is_record(root: Column, at: str, shape: Record) -> Column:
    """Whether an object stands at a path. What has a field is one; only without, the kind of all that it holds is worked out."""
    return _some(root, at, shape) | kind_of(F.try_variant_get(root, f"$.{at}" if at else "$", "variant")).startswith("OBJECT")


def _many(found: Column, shape: Many, lead: Column, wrong: Column, right: Column) -> Column:
    """Problems of a list: of its kind, of too many items, of single items, or of too few."""
    size = F.size(found)
    counted = lambda word, n: F.array(F.concat(lead, F.lit(f": List should have at {word} {n} item{'' if n == 1 else 's'} after validation, not "), size.cast("string")))
    each = F.flatten(F.transform(found, lambda x, i: _parts(x, "", shape.item, F.concat_ws(".", lead, i.cast("string")), F.lit(True))))
    out = F.when(~right, wrong)
    if shape.most is not None:
        out = out.when(size > shape.most, counted("most", shape.most))
    if not shape.least:
        return out.otherwise(each)
    return out.when(size < shape.least, let(each, lambda e: F.when(F.size(e) > 0, e).otherwise(counted("least", shape.least)))).otherwise(each)


def _leaf(root: Column, at: str, kind: Column, shape: Shape) -> Column:
    """The message of a value that is neither list nor record, or null."""
    if isinstance(shape, Flag):
        return _first([(kind == "BOOLEAN", NO_FLAG)])
    if isinstance(shape, Whole):
        n, high = child(root, at, "decimal(38,0)"), 2**63 - 1 if shape.high is None else shape.high
        low = [] if shape.low is None else [(n >= shape.low, f"Input should be greater than or equal to {shape.low}")]
        return _first([(_is_whole(kind), NO_WHOLE), *low, (n <= high, f"Input should be less than or equal to {high}")])
    if isinstance(shape, Number):
        return _first([((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), NO_NUMBER), (F.abs(child(root, at, "double")) < float("inf"), NO_FINITE)])
    s, plural = child(root, at, "string"), lambda n: f"{n} character{'' if n == 1 else 's'}"
    tests = [(kind == "STRING", NO_TEXT)]
    tests += [(F.char_length(s) >= shape.least, f"String should have at least {plural(shape.least)}")] if shape.least else []
    tests += [(F.char_length(s) <= shape.most, f"String should have at most {plural(shape.most)}")] if shape.most is not None else []
    return _first([*tests, *[(test(s), message) for test, message in shape.tests]])


def number_text(x: Column, least_exponent: int = 16, point: bool = True, most_zeros: int = 4) -> Column:
    """A double as text that reads back as itself with the fewest digits: without exponent below 10**least_exponent and from 10**-most_zeros on.

    The defaults are Python's; JSON text of browsers has 21, False and 6 (whole numbers without a point).
    """
    rounded = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda p: F.call_function("format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("e")), F.abs(x)))
    shortest = F.element_at(F.filter(rounded, lambda s: s.cast("double") == F.abs(x)), 1)
    parts = F.struct(F.translate(F.substring_index(shortest, "e", 1), ".", "").alias("digits"), F.substring_index(shortest, "e", -1).try_cast("int").alias("exp"))

    def written(p: Column) -> Column:
        d, e, n = p["digits"], p["exp"], F.char_length(p["digits"])
        zeros = lambda k: F.repeat(F.lit("0"), k)
        whole = F.concat(d, zeros(e + 1 - n), F.lit(".0" if point else ""))
        inner = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))
        small = F.concat(F.lit("0."), zeros(-e - 1), d)
        mantissa = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""))
        power = F.abs(e).cast("string")
        exponent = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.char_length(power) < 2, F.concat(F.lit("0" if point else ""), power)).otherwise(power))
        return F.when((e < -most_zeros) | (e >= least_exponent), F.concat(mantissa, exponent)).when(e < 0, small).when(n <= e + 1, whole).otherwise(inner)

    negative = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    sign = negative if point else F.when(x < 0, "-").otherwise("")
    any_ = F.when(F.isnan(x), "NaN").otherwise(F.concat(sign, F.when(F.abs(x) == float("inf"), "Infinity").otherwise(let(parts, written))))
    # up to 15 digits, no other number of so few reads back as the same double
    cents = F.when((F.abs(x) < 1e12) & (x != 0), x).try_cast("decimal(20,2)")
    plain = F.regexp_replace(cents.cast("string"), r"(?<=\.\d)0\z" if point else r"\.?0+\z", "")
    return F.when(cents.cast("double") == x, plain).otherwise(any_)


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def string_text(s: Column) -> Column:
    """A string as JSON writes it; characters beyond ASCII stay as they are."""
    out = s
    for plain, escaped in _ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    # other control characters are rare
    codes = F.sequence(F.lit(0), F.lit(31))
    rest = F.aggregate(codes, out, lambda acc, c: F.replace(acc, F.char(c), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), rest).otherwise(out), F.lit('"'))


@dataclass(frozen=True)
class Style:
    """How text is laid out. indent: blanks of a level, or None for one line; ordered: keys in order of their characters; browser: numbers as browsers write them."""

    comma: str = ","
    colon: str = ":"
    indent: int | None = None
    ordered: bool = False
    browser: bool = False


CANONICAL, PRETTY, SPACED = Style(ordered=True), Style(colon=": ", indent=2, browser=True), Style(", ", ": ")


def json_text(value: Column, shape: Shape, style: Style = CANONICAL) -> Column:
    """A value of a shape as text. Fields that are absent are left out; what departs from the shape is written as it is."""

    def number(x: Column) -> Column:
        return number_text(x, 21, False, 6) if style.browser else number_text(x)

    def written(root: Column, at: str, own: Shape, level: int) -> Column:
        # a record's or list's parts stand in its text once: what is written twice would be worked out twice on every level above
        v, told = child(root, at), F.to_json(child(root, at))
        gap = lambda n: F.lit("" if style.indent is None else "\n" + " " * (style.indent * n))
        comma = style.comma if style.indent is None else f",\n{' ' * (style.indent * (level + 1))}"
        wrapped = lambda opened, parts, closed: F.concat(F.lit(opened), gap(level + 1), parts, gap(level), F.lit(closed))
        # plain JSON text of a string differs from string_text() in codes of rare control characters only
        rare = F.contains(told, F.lit("\\u00"))
        if isinstance(own, Text):
            return F.when(rare & (kind_of(v) == "STRING"), string_text(child(root, at, "string"))).otherwise(told)
        if isinstance(own, Whole | Number):
            kind = kind_of(v)
            return F.when(_is_whole(kind), child(root, at, "string")).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), number(child(root, at, "double"))).otherwise(told)
        if isinstance(own, Many):
            found = child(root, at, "array<variant>")
            parts = F.array_join(F.transform(found, lambda x: written(x, "", own.item, level + 1)), comma)
            listed = F.when(found.isNull(), told).when(F.size(found) == 0, "[]").otherwise(wrapped("[", parts, "]"))
            if isinstance(own.item, Text) and style.indent is None and comma == ",":
                return F.when(rare, listed).otherwise(told)
            return listed
        if isinstance(own, Record):
            names = sorted(own.fields) if style.ordered else list(own.fields)
            each = [F.concat(F.lit(f'"{name}"{style.colon}'), written(root, _under(at, name), own.fields[name], level + 1)) for name in names]
            return F.when(_some(root, at, own), wrapped("{", F.concat_ws(comma, *each), "}")).when(kind_of(v).startswith("OBJECT"), "{}").otherwise(told)
        return told

    return written(value, "", shape, 0)
