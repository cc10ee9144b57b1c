"""Rules of a descriptor's parts, checked on the parts as they were written.

Parts are VARIANT columns, so a number where a text belongs, a text where a list belongs, and
a null beside an absent field are told apart.  Every rule gives problems as texts that name
the place: ``missing version``, ``wrong type of dataContract.schema[2].scale``,
``invalid tags[0].source``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.names import canonical_member
from concordat.functions.types import CONTRACT_TYPES
from concordat.operators.components import BASE_FIELDS, CONNECTION_TYPES

# Members of a tag's fields, the first being the default.
TAG_SOURCES = ["Classification", "Glossary"]
TAG_LABEL_TYPES = ["Manual", "Propagated", "Automated", "Derived"]
TAG_STATES = ["Confirmed", "Suggested"]

_INT_MAX = 2147483647


@dataclass(frozen=True)
class Rule:
    """What a part must be: its form, which values are allowed, and what lies in it.

    ``other`` is a second name it may be written under.
    """

    form: Callable[[str], str] | None
    allowed: Callable[[str], str] | None = None
    required: bool = False
    nullable: bool = True
    fields: Mapping[str, Rule] = field(default_factory=dict)
    items: Rule | None = None
    other: str | None = None


# Forms and allowed values are SQL over the SQL text of a part: the rules make some thousand
# expressions, which is quick to parse but slow to build call by call.


def _text_of(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def _one_of(text: str, names: list[str]) -> str:
    return f"{text} IN ({', '.join(repr(n) for n in names)})"


def _is_text(value: str) -> str:
    return f"schema_of_variant({value}) = 'STRING'"


def _is_object(value: str) -> str:
    return f"try_variant_get({value}, '$', 'map<string,variant>') IS NOT NULL"


def _is_list(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>') IS NOT NULL"


def _is_number(value: str) -> str:
    return f"schema_of_variant({value}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)'"


def _is_integer(value: str) -> str:
    """A whole number in the range of an integer, or a text that reads as one."""
    text = f"trim({_text_of(value)})"
    return (
        f"(({_is_text(value)} OR {_is_number(value)}) AND {text} RLIKE '^[+-]?[0-9]+([.]0*)?$'"
        f" AND abs(try_cast({text} AS double)) <= {_INT_MAX})"
    )


def _is_moment(value: str) -> str:
    return f"({_is_number(value)} OR ({_is_text(value)} AND try_cast({_text_of(value)} AS timestamp) IS NOT NULL))"


def _is_url(value: str) -> str:
    return f"{_text_of(value)} RLIKE '(?i)^(?!(https?|wss?|ftp):/*$)[a-z][a-z0-9+.-]*:[^ ].*$'"


TEXT = Rule(_is_text)
INTEGER = Rule(_is_integer)
MOMENT = Rule(_is_moment)
URL = Rule(_is_text, _is_url)
OBJECT = Rule(_is_object)
ANYTHING = Rule(None)
CONTRACT_TYPE = Rule(_is_text, lambda v: _one_of(f"upper({_text_of(v)})", CONTRACT_TYPES))


def members(names: list[str]) -> Rule:
    """One of the names in any case."""
    return Rule(_is_text, lambda v: _one_of(f"lower({_text_of(v)})", [n.lower() for n in names]))


def list_of(items: Rule) -> Rule:
    return Rule(_is_list, items=replace(items, nullable=False))


def object_with(fields: Mapping[str, Rule]) -> Rule:
    return Rule(_is_object, fields=fields)


def needed(rule: Rule) -> Rule:
    """Must be there and not null."""
    return replace(rule, required=True, nullable=False)


def defaulted(rule: Rule) -> Rule:
    """May be absent, which means its default, but not null."""
    return replace(rule, nullable=False)


# The fields of each part and which of them must be there.
TAG = object_with({
    "tagFQN": needed(TEXT),
    "description": TEXT,
    "source": defaulted(members(TAG_SOURCES)),
    "labelType": defaulted(members(TAG_LABEL_TYPES)),
    "state": defaulted(members(TAG_STATES)),
    "href": TEXT,
})
COLUMN = object_with({
    "name": needed(TEXT),
    "dataType": needed(CONTRACT_TYPE),
    "dataLength": INTEGER,
    "constraint": TEXT,
    "precision": INTEGER,
    "scale": INTEGER,
    "description": TEXT,
    "tags": list_of(TAG),
})
AGREEMENT_FIELDS = [
    "purpose", "billing", "security", "intendedUsage", "limitations", "lifeCycle", "confidentiality",
]
_BASE = {
    **{name: needed(TEXT) for name in BASE_FIELDS},
    "specific": replace(ANYTHING, required=True),
    "fullyQualifiedName": TEXT,
}
_PLACED = {"platform": TEXT, "technology": TEXT}
KINDS: dict[str, Rule] = {
    "outputport": object_with({
        **_BASE,
        "version": needed(TEXT),
        "dependsOn": needed(list_of(TEXT)),
        **_PLACED,
        "outputPortType": needed(TEXT),
        "creationDate": MOMENT,
        "startDate": MOMENT,
        "retentionTime": TEXT,
        "processDescription": TEXT,
        "dataContract": needed(object_with({"schema": list_of(COLUMN)})),
        "dataSharingAgreement": object_with({name: TEXT for name in AGREEMENT_FIELDS}),
        "tags": needed(list_of(TAG)),
        "sampleData": OBJECT,
        "semanticLinking": needed(list_of(OBJECT)),
    }),
    "workload": object_with({
        **_BASE,
        "version": needed(TEXT),
        "dependsOn": needed(list_of(TEXT)),
        **_PLACED,
        "workloadType": TEXT,
        "connectionType": needed(members(CONNECTION_TYPES)),
        "tags": needed(list_of(TAG)),
        "readsFrom": list_of(TEXT),
    }),
    "storage": object_with({
        **_BASE,
        "dependsOn": needed(list_of(TEXT)),
        **_PLACED,
        "storageType": TEXT,
        "tags": needed(list_of(TAG)),
    }),
    "observability": object_with({
        **_BASE,
        "endpoint": needed(URL),
        **{name: needed(OBJECT) for name in (
            "completeness", "dataProfiling", "freshness", "availability", "dataQuality")},
    }),
}
PRODUCT = object_with({
    **{name: needed(TEXT) for name in (
        "id", "name", "description", "kind", "domain", "version", "environment",
        "dataProductOwner", "ownerGroup", "devGroup")},
    "tags": needed(list_of(TAG)),
    "specific": needed(OBJECT),
    "components": needed(Rule(_is_list)),
    **{name: TEXT for name in (
        "fullyQualifiedName", "dataProductOwnerDisplayName", "email", "informationSLA", "status", "maturity")},
    "billing": OBJECT,
})


_NO_PROBLEMS = "CAST(array() AS array<string>)"


def _own_problem(value: str, rule: Rule, path: str) -> str:
    """SQL of the problem of a part itself, null when there is none."""

    def says(verb: str) -> str:
        return f"concat('{verb} ', {path})"

    is_null = f"is_variant_null({value})"
    if rule.required:
        cases = [(f"{value} IS NULL" if rule.nullable else f"{value} IS NULL OR {is_null}", says("missing"))]
    else:
        cases = [(f"{value} IS NULL", "NULL")]
    cases.append((is_null, "NULL" if rule.nullable else says("wrong type of")))
    if rule.form is not None:
        cases.append((f"NOT coalesce({rule.form(value)}, false)", says("wrong type of")))
    if rule.allowed is not None:
        cases.append((f"NOT coalesce({rule.allowed(value)}, false)", says("invalid")))
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + " END"


def _field_problems(root: str, place: str, rule: Rule, prefix: str, depth: int) -> str:
    """SQL of the problems of the fields of the object at ``place`` below ``root``; none if it is no object."""
    own, inner = [], []
    for name, of_field in rule.fields.items():
        at = f"concat({prefix}, '{name}')"
        value = f"try_variant_get({root}, '{place}.{name}', 'variant')"
        if of_field.other is not None:
            second = f"try_variant_get({root}, '{place}.{of_field.other}', 'variant')"
            if of_field.items is not None:
                listed = _item_problems(root, f"{place}.{of_field.other}", of_field.items, at, depth)
                inner.append(f"CASE WHEN {value} IS NULL THEN {listed} ELSE {_NO_PROBLEMS} END")
            value = f"coalesce({value}, {second})"
        own.append(_own_problem(value, of_field, at))
        if of_field.fields:
            inner.append(_field_problems(root, f"{place}.{name}", of_field, f"concat({at}, '.')", depth))
        if of_field.items is not None:
            inner.append(_item_problems(root, f"{place}.{name}", of_field.items, at, depth))
    listed = f"concat({', '.join([f'array_compact(array({", ".join(own)}))', *inner])})"
    whole = f"try_variant_get({root}, '{place}', 'variant')"
    return f"CASE WHEN {_is_object(whole)} THEN {listed} ELSE {_NO_PROBLEMS} END"


def _item_problems(root: str, place: str, rule: Rule, path: str, depth: int) -> str:
    """SQL of the problems of the items of a list, each with its number."""
    item, number = f"item{depth}", f"number{depth}"
    at = f"concat({path}, '[', {number}, ']')"
    found = f"array_compact(array({_own_problem(item, rule, at)}))"
    if rule.fields:
        found = f"concat({found}, {_field_problems(item, '$', rule, f"concat({at}, '.')", depth + 1)})"
    items = f"try_variant_get({root}, '{place}', 'array<variant>')"
    return f"coalesce(flatten(transform({items}, ({item}, {number}) -> {found})), {_NO_PROBLEMS})"


def product_problems(product: str) -> str:
    """SQL of the problems of a product's own fields, without those of its components."""
    return _field_problems(product, "$", PRODUCT, "''", 0)


def component_problems(component: str) -> str:
    """SQL of the problems of a component by the rules of its kind.

    An unknown kind is the only problem of its component.
    """
    kind = f"try_variant_get({component}, '$.kind', 'string')"
    cases = [f"WHEN '{name}' THEN {_field_problems(component, '$', rule, "''", 0)}" for name, rule in KINDS.items()]
    return f"CASE {kind} {' '.join(cases)} ELSE array(concat('unknown kind ', coalesce({kind}, 'none'))) END"


def with_tag_defaults(tags: Column) -> Column:
    """Tags with their members in canonical case and defaults where they are absent."""

    def filled(tag: Column) -> Column:
        for name, names in (("source", TAG_SOURCES), ("labelType", TAG_LABEL_TYPES), ("state", TAG_STATES)):
            tag = tag.withField(name, F.coalesce(canonical_member(tag[name], names), F.lit(names[0])))
        return tag

    return F.transform(tags, filled)
