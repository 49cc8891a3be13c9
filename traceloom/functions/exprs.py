"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns and word lists that decide results -------------------------------
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # ASCII word boundaries
IGNORED_PATH = r"(^|/)(node_modules|\.git|dist|build|\.next|coverage|\.turbo|storybook-static)(/|$)"
TASK_ID = rf"{_B}([A-Z]{{1,5}}-[0-9]+){_E}"
_BRANCH = r"""['"]?([^\s'"&|;]+)"""
SWITCH = rf"{_B}git\s+(?:-C\s+\S+\s+)?(?:checkout|switch)\s+(?![-0-9]){_BRANCH}"
WORKTREE = rf"{_B}git\s+worktree\s+add{_E}[^&|;]*?\s-b\s+{_BRANCH}"
PUSH_BRANCH = rf"{_B}git\s+push{_E}[^&|;]*?{_B}origin\s+(?:-u\s+)?{_BRANCH}"
PR_HEAD = rf"{_B}gh\s+pr\s+create{_E}[^&|;]*?--head\s+{_BRANCH}"
PR_BASE = rf"{_B}gh\s+pr\s+create{_E}[^&|;]*?--base[=\s]+{_BRANCH}"
NEW_WITH_START = rf"{_B}git[^\S\n]+(?:-C[^\S\n]+\S+[^\S\n]+)?(?:checkout[^\S\n]+-[bB]|switch[^\S\n]+-c)[^\S\n]+{_BRANCH}(?:[^\S\n]+([A-Za-z0-9._/-]+)(?=[^\S\n]|$(?![\s\S])))?"
DELETE = rf"{_B}git\s+branch\s+-[dD]\s+{_BRANCH}"
MERGE = rf"{_B}gh\s+pr\s+merge\s+([0-9]+)"
COMMIT = rf"{_B}git\s+(?:-C\s+\S+\s+)?commit{_E}"
PUSH = rf"{_B}git\s+(?:-C\s+\S+\s+)?push{_E}"
PR_TITLE = rf"""{_B}gh\s+pr\s+create{_E}[\s\S]*?--title[=\s]+(?:"((?:\\.|[^"\\])*)"|'([^']*)'|(\S+))"""
#: name, pattern; in this order
MASKS = [
    ("UUID", rf"(?i){_B}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{_E}"),
    ("SHA", rf"(?i){_B}[0-9a-f]{{7,40}}{_E}"),
    # a word that leads into no path does so from none of its letters, so only its first is tried
    ("PATH", r"(?<![A-Za-z0-9_.-])(?:\.{0,2}/)?(?:[A-Za-z0-9_.-]++/)+[A-Za-z0-9_.-]++"),
    ("DURATION", rf"(?i){_B}[0-9]+(?:\.[0-9]+)?\s?(?:ms|s|sec|seconds|min){_E}"),
    ("LINENO", rf":[0-9]+:[0-9]+{_E}"),
    ("EXITCODE", rf"(?i){_B}(?:exit code|exit status)[: ]+[0-9]+{_E}"),
    ("NUM", r"[0-9]+"),
]
SHELL_ANCHORS = [rf"^[A-Za-z0-9_]*Error{_E}.*$", r"^\s*at\s.*$", r"(?i)exit (?:code|status)[: ]+[0-9]+"]
TEST_ANCHORS = [r"(?i)[0-9]+\s+passed.*[0-9]+\s+failed", r"(?i)[0-9]+\s+failed.*[0-9]+\s+passed", r"error TS[0-9]+:.*$", r"^\s*✖?\s*[A-Za-z0-9_-]+/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*\s*$"]
ERROR_CLASSES = [rf"^([A-Za-z0-9_]*Error){_E}", r"error (TS[0-9]+):", r"^([A-Za-z0-9_-]+/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*)\s*$"]
SOURCE_TYPES = [("pr", r"^pr-[0-9]+-"), ("deepdive", r"^deepdive-"), ("session", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-")]
# ---------------------------------------------------------------------------------------------


def lit_or(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(lit_or(c), F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where it is missing or empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# H1 typed JSON access: wrong types are null (strings) or 0 (numbers)
def json_kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def json_str(v: Column, path: str) -> Column:
    return F.when(json_kind(v, path) == "STRING", empty_to_null(F.try_variant_get(v, path, "string")))


def json_num(v: Column, path: str) -> Column:
    ok = json_kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    return F.coalesce(F.when(ok, F.try_variant_get(v, path, "double")), F.lit(0.0)).cast("long")


def json_bool(v: Column, path: str) -> Column:
    return F.coalesce(F.when(json_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


# H6, H7 text of JSON values
_TOKEN_OF_JSON = r'"(?:[^"\\]|\\.)*+":?|[\[\]{}]'


def string_leaves(json: Column, depth: int = 6, most: int = 65) -> Column:
    """The string values of a JSON text, not its keys and no empty ones, down to ``depth`` and at most ``most`` of them.

    The text is cut into brackets and strings, and one fold counts the open brackets.
    """
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        kept = x.startswith('"') & x.endswith('"') & (x != '""') & (a["open"] <= depth) & (F.size(a["found"]) < most)
        opened = F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        return F.struct((a["open"] + opened).alias("open"), F.when(kept, F.concat(a["found"], F.array(x))).otherwise(a["found"]).alias("found"))

    found = F.aggregate(F.regexp_extract_all(json, F.lit(_TOKEN_OF_JSON), F.lit(0)), start, step, lambda a: a["found"])
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>"), F.array().cast("array<string>"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character beyond the basic plane counts twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_left(text: Column, most: int) -> Column:
    """The first ``most`` UTF-16 units; a character of two units that does not fit is left out."""
    # as many characters as units, at most, are looked at; where some count twice, units are cut
    head = F.left(text, F.lit(most))
    units = F.encode(head, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.decode(F.when(half, F.substring(units, 1, 2 * most - 2)).otherwise(F.substring(units, 1, 2 * most)), "UTF-16BE")
    return F.when(utf16_length(head) > most, cut).otherwise(head)


# H2 references
def ref(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), *parts)


def file_ref(repo: Column, path: Column) -> Column:
    return ref("file", F.when(repo.isNull(), path).otherwise(F.concat(repo, F.lit("/"), path)))


def pr_ref(repo: Column, number: Column) -> Column:
    return ref("pr", repo, F.lit("#"), number.cast("string"))


def branch_ref(repo: Column, name: Column) -> Column:
    return ref("branch", F.when(repo.isNull(), name).otherwise(F.concat(repo, F.lit("/"), name)))


# H3 / H4 hashes and durations
def template_id(tool: Column, masked: Column) -> Column:
    return F.sha2(F.concat(tool, F.lit("\u0000"), masked), 256)


def instant(ts: Column) -> Column:
    """ISO-8601 text as a timestamp, null where it is none."""
    return F.try_to_timestamp(ts)


def ms_between(later: Column, earlier: Column) -> Column:
    return F.round((F.unix_micros(later) - F.unix_micros(earlier)) / 1000).cast("long")


# H8 / H9 / H10 shell text
def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def real_command(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(raw), r"^(?:cd\s+[^&;]+(?:&&|;)\s*){1,4}", ""))


def normal_path(path: Column) -> Column:
    """``a/b/../c`` as ``a/c``, up to four levels up, and ``a/./b`` as ``a/b``."""
    path = F.regexp_replace(path, r"/(?:\./)+", "/")
    for _ in range(4):
        path = F.regexp_replace(path, r"/(?!\.\./)[^/]+/\.\.(?=/|$)", "")
    return path


def command_dir(raw: Column, cwd: Column, home: str = "~") -> Column:
    """``git -C`` wins over a leading ``cd``; relative ones stand on the session's directory."""
    d = F.coalesce(extract(raw, rf"{_B}git\s+-C\s+['\"]?([^\s'\"]+)"), F.trim(extract(F.trim(raw), r"^cd\s+['\"]?([^&;'\"]+?)['\"]?\s*(?:&&|;)")))
    d = F.regexp_replace(d, "^~(?=/|$)", home)
    joined = F.when(d.startswith("/") | d.startswith("~"), d).otherwise(F.concat_ws("/", cwd, d))
    for _ in range(4):  # a/b/../c
        joined = F.regexp_replace(joined, r"/[^/]+/\.\.(?=/|$)", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(joined, r"/\.(?=/|$)", ""), "(?<=.)/$", ""), cwd)


# H11 - H15 git intent
def clean_branch(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^origin/", ""), "['\"]", "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def git_intent(raw: Column) -> Column:
    """Struct of set_branch, branch_base, deleted_branch, merged_pr, commit, push; null where no git or gh is named.

    Each pattern is matched once; all else works on what the patterns captured.
    """
    patterns = {"created": (NEW_WITH_START, 1), "start": (NEW_WITH_START, 2), "worktree": (WORKTREE, 1), "head": (PR_HEAD, 1), "pushed": (PUSH_BRANCH, 1), "switched": (SWITCH, 1), "base": (PR_BASE, 1), "deleted": (DELETE, 1), "merged": (MERGE, 1)}
    captured = F.struct(*[F.regexp_extract(raw, p, g).alias(name) for name, (p, g) in patterns.items()], raw.contains("<<").alias("heredoc"), raw.rlike(COMMIT).alias("commit"), raw.rlike(PUSH).alias("push"))

    def named(c: Column) -> Column:
        name = F.coalesce(*[empty_to_null(c[k]) for k in ("created", "worktree", "head", "pushed", "switched")])
        base = F.when(c["created"] != "", F.when(~c["heredoc"], c["start"])).when((c["worktree"] == "") & (c["head"] != ""), c["base"])
        return F.struct(clean_branch(name).alias("name"), clean_branch(base).alias("base"), empty_to_null(clean_branch(c["deleted"])).alias("deleted"), c["merged"].alias("merged"), c["commit"].alias("commit"), c["push"].alias("push"))

    def checked(c: Column) -> Column:
        real = lambda x: F.when((x != "") & (x != "HEAD") & (x != "/") & ~x.startswith("-") & ~x.contains(":"), x)
        return F.struct(real(c["name"]).alias("set_branch"), real(c["base"]).alias("base"), c["deleted"].alias("deleted_branch"), empty_to_null(c["merged"]).cast("long").alias("merged_pr"), c["commit"].alias("commit"), c["push"].alias("push"))

    def whole(c: Column) -> Column:
        base = F.when(c["base"] != c["set_branch"], c["base"])
        return F.struct(c["set_branch"].alias("set_branch"), base.alias("branch_base"), c["deleted_branch"].alias("deleted_branch"), c["merged_pr"].alias("merged_pr"), c["commit"].alias("commit"), c["push"].alias("push"))

    return F.when(raw.contains("git") | raw.contains("gh "), bound(bound(bound(captured, named), checked), whole))


def pr_title(raw: Column) -> Column:
    quoted = F.regexp_replace(extract(raw, PR_TITLE, 1), r'\\(["$`\\\n])', "$1")
    return F.when(raw.contains("gh "), F.coalesce(quoted, extract(raw, PR_TITLE, 2), extract(raw, PR_TITLE, 3)))


def task_id(command: Column, words: tuple[str, ...]) -> Column:
    """The task that a command names, if its first word is one of ``words``."""
    c = real_command(command)
    return F.when(F.split(c, r"\s+")[0].isin(*words), extract(c, TASK_ID))


# H16 - H24 text
def base_model(model: Column) -> Column:
    m = F.regexp_replace(model, r"\[[^\]]*\]$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(m, "-fast$", ""), "-[0-9]{8}$", ""))


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000)).cast("int")


def pr_number(value: Column) -> Column:
    return F.coalesce(extract(value, r"/pull/([0-9]+)"), F.regexp_replace(value, "^#", ""))


def elapsed_text(since: Column, now: Column) -> Column:
    hours = F.floor((F.unix_micros(now) - F.unix_micros(since)) / 3_600_000_000)
    days = F.floor(hours / 24)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(hours < 1, "just now").when(hours < 24, say(hours, "hour")).when(days < 14, say(days, "day")).otherwise(F.concat(say(days, "day"), F.lit(" — likely needs context refresher")))


def slug(label: Column) -> Column:
    return F.coalesce(empty_to_null(F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "-"), "^-+|-+$", "")), F.lit("untitled"))


def truncate(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def source_type(name: Column) -> Column:
    out = F.lit("pointer")
    for kind, pattern in reversed(SOURCE_TYPES):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def first_heading(body: Column, lines: int = 200) -> Column:
    return extract(F.array_join(F.slice(F.split(body, "\n"), 1, lines), "\n"), r"(?m)^#{1,6}\s+(.+?)\s*$")


def source_links(body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\]\((?:\./)?sources/([^)\s#]+)"), F.lit(1))))


def body_lines(body: Column) -> Column:
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+$", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))


# H25 validity
def is_date(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_instant(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})$") & F.try_to_timestamp(value).isNotNull(), F.lit(False))


# K1 - K5 signatures and masks
def tool_type(name: Column) -> Column:
    return F.when(name == "Bash", "Bash").when(name == "Read", "Read").when(name.isin("Edit", "MultiEdit"), "Edit").otherwise("generic")


def _first_line(lines: Column, rules: list[str]) -> Column:
    return F.coalesce(*[F.trim(F.try_element_at(F.filter(lines, _matches(p)), F.lit(1))) for p in rules])


def _matches(pattern: str):
    return lambda line: line.rlike(pattern)


def signature(tool: Column, text: Column) -> Column:
    """Struct of error_class, anchor, anchored, bucket and signature."""
    lines = F.split(text, "\n")
    blank = F.filter(lines, lambda x: F.trim(x) != "")
    n = F.size(blank)
    found = F.when(tool == "test", F.coalesce(_first_line(lines, TEST_ANCHORS), _first_line(lines, SHELL_ANCHORS))).otherwise(_first_line(lines, SHELL_ANCHORS))
    found = F.when(tool != "git", found)
    anchor = F.when(tool == "git", F.trim(lines[0])).otherwise(F.coalesce(found, F.trim(F.try_element_at(blank, F.lit(-1))), F.lit("")))
    kind = F.coalesce(*[extract(anchor, p) for p in ERROR_CLASSES], F.lit("unknown"))
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").otherwise("6+")
    return F.struct(kind.alias("error_class"), anchor.alias("anchor"), found.isNotNull().alias("anchored"), bucket.alias("bucket"), F.concat(kind, F.lit(" "), anchor, F.lit(" ["), bucket, F.lit("]")).alias("signature"))


def mask(line: Column) -> Column:
    for name, pattern in MASKS:
        line = F.regexp_replace(line, pattern, f"<{name}>")
    return line


def mask_params(line: Column) -> Column:
    """Name -> the text that each mask replaced first."""
    pairs = []
    for name, pattern in MASKS:
        pairs += [F.lit(name), extract(line, pattern, 0)]
        line = F.regexp_replace(line, pattern, f"<{name}>")
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
