"""Column functions on target ids such as ``//pkg/path:name`` or ``@repo//pkg:name``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids that hold one of these are build infrastructure.
DEFAULT_EXCLUDES = (
    "@bazel_tools//",
    "@io_bazel_rules_scala//",
    "@core_server_build_tools//",
    "@remotejdk",
    "@remote_java_tools",
    "tools/jdk:",
    "tools/test:",
    ".sh",
    ".srcjar",
    "_deploy.jar",
    "_java_runtime",
    "_host_java_runtime",
    ":scalac",
    ":exe",
    "coverage/instrumenter",
    "dependency_analyzer",
    "phase_",
    "dep_trackers",
)
#: Endings of source files.
SOURCE_ENDINGS = ("java", "scala", "py", "go", "rs")


def first_target(value: Column) -> Column:
    """Each quoted id of a line cut before a literal backslash-n."""
    return F.regexp_replace(value, r'"([^"]*?)\\n[^"]*"', '"$1"')


def package_of(id_: Column) -> Column:
    """What stands before the target name, with its repository; the id itself if it has no package."""
    found = F.regexp_extract(id_, r"^(@[^/]+//[^:]*|//[^:]*)", 1)
    return F.when(found == "", id_).otherwise(found)


def is_noise(id_: Column, excludes: Sequence[str] = (), includes: Sequence[str] = ()) -> Column:
    """Whether an id is dropped: a source file after its last colon, always; one that holds an
    exclude; or, if there are includes, one that holds none. Empty patterns are ignored."""
    excludes, includes = ([p for p in (x.strip() for x in ps) if p] for ps in (excludes, includes))
    noise = id_.rlike(rf":[^:]*\.({'|'.join(SOURCE_ENDINGS)})$")
    noise = reduce(lambda c, p: c | id_.contains(p), excludes, noise)
    if includes:
        noise = noise | ~reduce(lambda c, p: c | id_.contains(p), includes[1:], id_.contains(includes[0]))
    return noise


def short_label(id_: Column, style: str = "plain") -> Column:
    """``plain`` drops leading slashes; ``search`` also shortens ``@repo//`` to an at sign; ``canvas`` keeps the
    last two parts of what is then longer than 40 characters and has more than two."""
    if style == "plain":
        return F.regexp_replace(id_, "^//", "")
    short = F.regexp_replace(F.regexp_replace(id_, "^//", ""), "^@[^/]+//", "@")
    if style == "search":
        return short
    parts = F.split(short, "/")
    last = F.array_join(F.slice(parts, -2, 2), "/")
    return F.when((F.length(short) > 40) & (F.size(parts) > 2), F.concat(F.lit(".../"), last)).otherwise(short)


def target_tag(id_: Column) -> Column:
    """The last part of the plain label, after its last colon."""
    return F.element_at(F.split(F.element_at(F.split(short_label(id_), "/"), -1), ":"), -1)


def node_kind(id_: Column, order: str = "canvas") -> Column:
    """Kind of a row of node metrics. ``canvas``: external, root, leaf, bridge, normal, where external
    also means third party; ``list``: root, leaf, external, normal."""
    root, leaf, bridge = F.col("is_root"), F.col("is_leaf"), F.col("is_bridge")
    repo = id_.startswith("@")
    if order == "canvas":
        return F.when(id_.contains("third_party") | repo, "external").when(root, "root").when(leaf, "leaf").when(bridge, "bridge").otherwise("normal")
    return F.when(root, "root").when(leaf, "leaf").when(repo, "external").otherwise("normal")
