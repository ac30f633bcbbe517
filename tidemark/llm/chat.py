"""Chat formatting by schema fingerprints, with DataFrame functions only.

A table's own nested field paths, less those that no layout names, are sorted and hashed; this fingerprint
is looked up among the declared ones, and what it is declared for is the mapping that turns the rows into
canonical turns. A layout declares one fingerprint for each choice of its optional paths. A fingerprint
that nobody declared fits a layout if it holds all its required paths: if it is the only one, it is taken,
otherwise the table is refused, as some of its fields would be lost. Rows of JSON text are fingerprinted
one by one, from their own keys, so one column may mix layouts; refused rows give null.

Canonical form: a struct column ``turns``: array<struct<role, text>>. The template writes
``<|start|>role<|sep|>text<|end|>`` for every turn. Control strings inside a role or text get a
backslash after their first character and backslashes are doubled, so the output reads back exactly.

Defined cases: null role or text is empty; rows with no turns give an empty output; repeated rows are
turns of their own, ordered by turn, role and text; a null key is a conversation like any other; texts of
any length are formatted whole (one conversation's output must fit a row); an empty table gives no rows;
extra columns do not take part, whatever their names, unless together they are another layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that mark structure in this template or in common chat templates.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
ESCAPE = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=INST\]|/INST\])"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping as data: the field paths it needs and how turns come from them.

    ``items``: an array of messages with a role and a text field; ``turns``: fixed (role, field) pairs,
    empty fields left out if named in ``optional``; ``by``: one row for each turn, grouped by a key.
    """

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    by: str | None = None
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Layout("sharegpt", ("conversations", "conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("input", "instruction", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout("prompt", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("rows", ("conv_id", "role", "text", "turn"), role="role", text="text", by="conv_id", order="turn"),
)


def fingerprint(paths: Column) -> Column:
    """Hash of the sorted distinct field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def declared(layouts: tuple[Layout, ...]) -> list[tuple[str, list[str]]]:
    """(layout, paths) of every shape that has a fingerprint: all required paths with any of the optional ones."""
    out = []
    for x in layouts:
        required = [p for p in x.paths if p not in x.optional]
        out += [(x.name, [*required, *some]) for n in range(len(x.optional) + 1) for some in combinations(x.optional, n)]
    return out


def layout_name(paths: Column, layouts: tuple[Layout, ...]) -> Column:
    """The layout for field paths by their fingerprint, else the only one that fits, else null."""
    known = F.array_intersect(paths, F.array(*map(F.lit, sorted({p for x in layouts for p in x.paths}))))
    shapes = [c for name, some in declared(layouts) for c in (fingerprint(F.array(*map(F.lit, some))), F.lit(name))]
    by_print = F.try_element_at(F.create_map(*shapes), fingerprint(known))
    fits = []
    for x in layouts:
        required = F.array(*[F.lit(p) for p in x.paths if p not in x.optional])
        fits.append(F.when(F.size(F.array_except(required, known)) == 0, F.lit(x.name)))
    fits = F.array_compact(F.array(*fits))
    return F.coalesce(by_print, F.when(F.size(fits) == 1, fits[0]))


def field_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Every nested path, lower case: ``a``, ``a.b`` in a struct, ``a[].b`` in an array."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name.lower(), f.dataType
        out.append(path)
        mark = "."
        while isinstance(kind, T.ArrayType):
            kind, mark = kind.elementType, "[]."
        if isinstance(kind, T.StructType):
            out += field_paths(kind, path + mark)
    return out


def select_layout(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout that the fingerprint of the table's fields is declared for; see above for others."""
    there = sorted(set(field_paths(df.schema)))
    paths = F.array(*map(F.lit, there)) if there else F.array().cast("array<string>")
    name = df.sparkSession.range(1).select(layout_name(paths, layouts).alias("name")).first()["name"]
    if name is None:
        raise ValueError(f"no layout, or more than one, fits the fields {there}")
    return next(x for x in layouts if x.name == name)


def _named(role: Column, names: dict[str, str]) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in names.items():
        out = F.when(out == old, F.lit(new)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _from_record(layout: Layout, get, has=lambda name: True) -> Column:
    """turns of one record; get(name) is the record's field, has(name) whether there is one."""
    if layout.items:
        turns = F.transform(get(layout.items), lambda m: _turn(_named(m[layout.role], layout.roles), m[layout.text]))
        return F.coalesce(turns, F.array().cast(TURNS))
    parts = []
    for role, name in layout.turns:
        if not has(name):
            continue
        one = F.array(_turn(F.lit(role), get(name)))
        parts.append(F.when(F.coalesce(get(name), F.lit("")) == "", F.array().cast(TURNS)).otherwise(one) if name in layout.optional else one)
    return F.concat(*parts)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``turns``; a table with one row for each turn becomes one row for each key."""
    layout = select_layout(df, layouts)
    if layout.by is None:
        names = {c.lower() for c in df.columns}
        return df.withColumn("turns", _from_record(layout, F.col, names.__contains__))
    turn = F.struct(F.col(layout.order).alias("at"), _named(F.col(layout.role), layout.roles).alias("role"), F.coalesce(F.col(layout.text), F.lit("")).alias("text"))
    rows = df.groupBy(F.col(layout.by)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def _prefixed(mark: str):
    return lambda key: F.concat(F.lit(mark), key)


def json_paths(column: Column, layouts: tuple[Layout, ...]) -> Column:
    """Field paths of JSON text, lower case: its own keys, and the keys of the elements of arrays that layouts name."""
    none = F.array().cast("array<string>")
    out = [F.coalesce(F.json_object_keys(column), none)]
    for items in sorted({x.items for x in layouts if x.items}):
        elements = F.from_json(column, f"`{items}` array<string>")[items]
        keys = F.flatten(F.transform(F.filter(elements, lambda e: e.isNotNull()), lambda e: F.coalesce(F.json_object_keys(e), none)))
        out.append(F.transform(F.coalesce(keys, none), _prefixed(f"{items}[].")))
    return F.transform(F.concat(*out), F.lower)


def canonical_json(df: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns`` for rows of JSON text in mixed layouts; text that no layout, or more than one, fits gives null."""
    by = tuple(x for x in layouts if x.by is None)
    out = df.withColumn("layout", layout_name(json_paths(F.col(column), by), by))
    turns = F.lit(None).cast(TURNS)
    for x in by:
        if x.items:
            record = F.from_json(F.col(column), f"`{x.items}` array<struct<`{x.role}`:string,`{x.text}`:string>>")
        else:
            record = F.from_json(F.col(column), ", ".join(f"`{k}` string" for _, k in x.turns))
        turns = F.when(F.col("layout") == x.name, _from_record(x, lambda k, r=record: r[k])).otherwise(turns)
    return out.withColumn("turns", turns)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, ESCAPE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(df: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``: [start, end) code points of the texts of the ``learn`` role, escaped."""
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == learn).alias("learn"),
        ),
    )
    size = len(END)
    df = df.withColumn("_pieces", piece)
    df = df.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    ends = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + size).alias("at"),
            F.when(
                p["learn"],
                F.concat(s["mask"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))),
            ).otherwise(s["mask"]).alias("mask"),
        ),
    )
    return df.withColumn("loss_mask", ends["mask"]).drop("_pieces")


def read_back(formatted: Column) -> Column:
    """turns from the template's output."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    body = F.transform(parts, lambda p: F.split(F.substring(p, len(START) + 1, 2147483647), r"<\|sep\|>", 2))
    return F.transform(body, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")
