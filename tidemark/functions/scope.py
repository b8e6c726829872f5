"""Partition filters and scopes: sets of prefixes, containment, permission."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import filled


def any_prefix(partition: Column | str, prefixes: list[str] | tuple[str, ...]) -> Column:
    """Does the partition start with one of the prefixes? Each is pushed down to a Parquet scan.

    Prefixes are literal and case counts; the empty one matches everything.
    """
    column = F.col(partition) if isinstance(partition, str) else partition
    if "" in prefixes:
        return column.isNotNull()
    return reduce(Column.__or__, [column.startswith(p) for p in prefixes], F.lit(False))


def is_prefix_of(partition: Column | str, value: str) -> Column:
    """The reverse: is the column a prefix of the value?"""
    column = F.col(partition) if isinstance(partition, str) else partition
    return F.lit(value).startswith(column)


def prefixes_of(text: Column) -> Column:
    """A filter text as an array of prefixes; a blank text has the empty prefix alone."""
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")


def contains(prefixes: Column, partition: Column) -> Column:
    return F.exists(prefixes, lambda p: partition.startswith(p))


def subset(inner: Column, outer: Column) -> Column:
    """Is each prefix of ``inner`` under some prefix of ``outer``? (arrays)"""
    return F.forall(inner, lambda a: F.exists(outer, lambda b: a.startswith(b)))


def equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def allowed(push: Column, wanted: Column, client_read: Column, client_write: Column, server_read: Column, server_write: Column) -> Column:
    """May a transfer of the filter run? A push needs what the client writes and the server reads; a pull the reverse."""
    pushed = subset(wanted, client_write) & subset(wanted, server_read)
    return F.when(push, pushed).otherwise(subset(wanted, client_read) & subset(wanted, server_write))


@dataclass(frozen=True)
class Filter:
    """A set of prefixes on the driver.

    A blank text matches everything. Adding two filters splits their joined text
    anew, so a blank one vanishes beside another, and two blank ones still match
    everything: a scope with no templates at all reaches all data.
    """

    template: str
    params: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def prefixes(self) -> tuple[str, ...]:
        return tuple(filled(self.template, self.params).split()) or ("",)

    def contains(self, partition: str) -> bool:
        return partition.startswith(self.prefixes)

    __contains__ = contains

    def __le__(self, other: Filter) -> bool:
        return all(p.startswith(other.prefixes) for p in self.prefixes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Filter) and set(self.prefixes) == set(other.prefixes)

    def __hash__(self) -> int:
        return hash(frozenset(self.prefixes))

    def __add__(self, other: Filter) -> Filter:
        return Filter(f"{filled(self.template, self.params)}\n{filled(other.template, other.params)}")

    def __iter__(self):
        return iter(self.prefixes)

    def __len__(self) -> int:
        return len(self.prefixes)

    def __str__(self) -> str:
        return "\n".join(self.prefixes)

    def column(self, partition: Column | str) -> Column:
        return any_prefix(partition, self.prefixes)


@dataclass(frozen=True)
class Scope:
    """What a certificate may read and write."""

    read_write: str = ""
    read_only: str = ""
    write_only: str = ""
    params: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def read(self) -> Filter:
        return Filter(self.read_write, self.params) + Filter(self.read_only, self.params)

    @property
    def write(self) -> Filter:
        return Filter(self.read_write, self.params) + Filter(self.write_only, self.params)

    def __le__(self, other: Scope) -> bool:
        return self.read <= other.read and self.write <= other.write

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Scope) and self.read == other.read and self.write == other.write

    def __hash__(self) -> int:
        return hash((self.read, self.write))

    def allows(self, wanted: Filter, peer: Scope, push: bool) -> bool:
        """``self`` is the client's scope, ``peer`` the server's."""
        return (wanted <= self.write and wanted <= peer.read) if push else (wanted <= self.read and wanted <= peer.write)
