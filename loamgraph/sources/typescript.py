"""Declarations and relationships of TypeScript and JavaScript sources, by tokens.

There is no compiler here: a tokenizer and a scan for declarations find nodes; names are resolved by joins of imports
with exports. Where several targets fit, none is linked. Edges found this way are marked ``heuristic``; containment and
exports are ``deterministic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.schema import Graph
from loamgraph.streaming.watch import Language

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|[{}()\[\];:,.<>=?!&|+\-*/%@#~^])"
)
KEYWORD_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "function": "function", "type": "type", "namespace": "namespace", "module": "namespace"}
EXPORTED = "export"  # in place of an imported name: the module's names are passed on
HTTP_METHODS = {"GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ALL"}
CLASS_MARKS = {"Controller": "controller", "Injectable": "service"}  # what a class with a decorator is
CLIENTS = {"fetch", "axios", "http", "https", "client"}  # whose calls are requests, not routes
STORES = {"prisma", "db"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "new", "constructor"}
MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "abstract", "override", "get", "set", "declare"}


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of all tokens but comments and white space."""
    return [(m.lastgroup, m[0], m.start()) for m in TOKEN.finditer(source) if m.lastgroup != "comment"]


def closing(found: list[tuple[str, str, int]], at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the last token if none does."""
    pairs = {"{": "}", "(": ")", "[": "]"}
    depth = 0
    for i in range(at, len(found)):
        if found[i][0] == "mark":
            if found[i][1] in pairs:
                depth += 1
            elif found[i][1] in pairs.values():
                depth -= 1
                if not depth:
                    return i
    return len(found) - 1


class Scan:
    """What one file declares, imports and uses."""

    def __init__(self, path: str, source: str):
        self.path, self.source = path, source
        self.found = tokens(source)
        self.nodes: list[dict] = []
        self.imports: list[tuple[str, str, str]] = []  # local name, imported name, module
        self.uses: list[tuple[str, str, str, int]] = []  # owner's qualified name, type, name, line
        self.starts = [0, *[m.end() for m in re.finditer("\n", source)]]
        self.seen: dict[str, int] = {}
        self.marks: list[tuple[str, str]] = []  # decorators, with their first literal, of what comes next
        self.bases: dict[str, str] = {}  # a controller's own part of its routes
        self.block(0, len(self.found), "")
        self.file_imports()
        self.relations()

    def line(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, offset)

    def add(self, kind: str, name: str, owner: str, first: int, last: int, exported: bool) -> str:
        qualified = f"{owner}.{name}" if owner else name
        n = self.seen[qualified] = self.seen.get(qualified, 0) + 1
        unique = qualified if n == 1 else f"{qualified}~{n - 1}"
        start = self.found[first][2]
        end = self.found[last][2] + len(self.found[last][1])
        signature = " ".join(self.source[start:end].split("{", 1)[0].split())[:300]
        self.nodes.append({"kind": kind, "name": name, "qualified": unique, "owner": owner, "start": start, "end": end, "start_line": self.line(start), "end_line": self.line(max(start, end - 1)), "exported": exported, "signature": signature})
        return unique

    def body(self, at: int, stop: int) -> tuple[int, int] | None:
        """The braces of the next block before a semicolon at this depth."""
        i = at
        while i < stop:
            text = self.found[i][1]
            if text == "{":
                return i, closing(self.found, i)
            if text in "([":
                i = closing(self.found, i)
            elif text == ";":
                return None
            i += 1
        return None

    def block(self, at: int, stop: int, owner: str) -> None:
        i = at
        exported = False
        while i < stop:
            kind, text, _ = self.found[i]
            after = self.found[i + 1] if i + 1 < stop else ("", "", 0)
            if text == "export":
                exported = True
            elif text == "@" and after[0] == "name":
                i = self.decorator(i, stop)
                continue
            elif text in KEYWORD_KINDS and after[0] == "name" and kind == "name":
                braces = self.body(i + 2, stop)
                last = braces[1] if braces else i + 1
                marks = dict(self.marks)
                kind = next((k for m, k in CLASS_MARKS.items() if m in marks), KEYWORD_KINDS[text]) if text == "class" else KEYWORD_KINDS[text]
                name = self.add(kind, after[1], owner, i, last, exported)
                self.bases[name] = marks.get("Controller", "")
                self.marks = []
                if braces and text in ("class", "interface"):
                    self.members(braces[0] + 1, braces[1], name, text)
                elif braces and text in ("namespace", "module"):
                    self.block(braces[0] + 1, braces[1], name)
                i, exported = last, False
            elif text in ("const", "let", "var") and after[0] == "name":
                end = i + 1
                while end < stop and self.found[end][1] != ";":
                    if self.found[end][1] in "{([":
                        end = closing(self.found, end)
                    elif end > i + 2 and self.line(self.found[end][2]) > self.line(self.found[end - 1][2]) and self.found[end][0] == "name":
                        end -= 1
                        break
                    end += 1
                end = min(end, stop - 1)
                inside = [t[1] for t in self.found[i:end]]
                function = "=>" in inside or "function" in inside
                self.add("function" if function else "constant" if text == "const" else "variable", after[1], owner, i, end, exported)
                i, exported = end, False
            elif text in ("test", "it") and after[1] == "(" and i + 2 < stop and self.found[i + 2][0] == "string":
                last = closing(self.found, i + 1)
                self.add("test", self.found[i + 2][1][1:-1], owner, i, last, False)
                i = last
            elif text in ("describe",) and after[1] == "(":
                braces = self.body(i + 3, stop) or self.inner(i + 1)
                if braces:
                    self.block(braces[0] + 1, braces[1], owner)
                    i = braces[1]
            elif text not in ("default", "declare", "abstract", "async"):
                exported = False
                if text in "{([":
                    i = closing(self.found, i)
            i += 1

    def decorator(self, at: int, stop: int) -> int:
        """The place after the decorator at ``at``, which is noted."""
        name, after, literal = self.found[at + 1][1], at + 2, ""
        if after < stop and self.found[after][1] == "(":
            if self.found[after + 1][0] == "string":
                literal = self.found[after + 1][1][1:-1]
            after = closing(self.found, after) + 1
        self.marks.append((name, literal))
        return after

    def inner(self, at: int) -> tuple[int, int] | None:
        last = closing(self.found, at)
        for i in range(at, last):
            if self.found[i][1] == "{":
                return i, closing(self.found, i)
        return None

    def members(self, at: int, stop: int, owner: str, of: str) -> None:
        i = at
        while i < stop:
            kind, text, _ = self.found[i]
            if text == "@":
                i = self.decorator(i, stop)
                continue
            if kind == "name":
                first = i
                while self.found[i][1] in MODIFIERS and i + 1 < stop and self.found[i + 1][0] == "name":
                    i += 1
                name = self.found[i][1]
                private = any(t[1] in ("private", "protected") for t in self.found[first:i])
                j = i + 1
                if j < stop and self.found[j][1] in "?!":
                    j += 1
                if j < stop and self.found[j][1] == "<":
                    while j < stop and self.found[j][1] != "(":
                        j += 1
                if j < stop and self.found[j][1] == "(":
                    end = closing(self.found, j)
                    braces = self.body(end + 1, stop) if of == "class" else None
                    last = braces[1] if braces else end
                    while not braces and last + 1 < stop and self.found[last][1] not in ";,":
                        last = closing(self.found, last + 1) if self.found[last + 1][1] in "{([" else last + 1
                    unique = self.add("constructor" if name == "constructor" else "method", name, owner, first, last, not private)
                    for mark, path in self.marks:
                        if mark.upper() in HTTP_METHODS:
                            whole = "/" + "/".join(p for p in (self.bases.get(owner, "").strip("/"), path.strip("/")) if p)
                            self.uses.append((unique, "ROUTED_FROM", f"{mark.upper()} {whole}", self.line(self.found[first][2])))
                    self.marks = []
                    i = last
                else:
                    end = j
                    while end < stop and self.found[end][1] not in ";,":
                        if self.found[end][1] in "{([":
                            end = closing(self.found, end)
                        elif end > j + 1 and self.line(self.found[end][2]) > self.line(self.found[end - 1][2]) and self.found[end][0] == "name":
                            break
                        end += 1
                    self.add("property", name, owner, first, min(end, stop) - 1, not private)
                    i = end - 1
            elif text in "{([":
                i = closing(self.found, i)
            i += 1

    def file_imports(self) -> None:
        for m in re.finditer(r"""import\s+(?:type\s+)?([\w$*{}\s,]+?)\s+from\s+["']([^"']+)["']""", self.source):
            names, module = m[1], m[2]
            if inner := re.search(r"\{([^}]*)\}", names):
                for part in filter(None, (p.strip() for p in inner[1].split(","))):
                    a, _, b = part.removeprefix("type ").partition(" as ")
                    self.imports.append(((b or a).strip(), a.strip(), module))
                names = names.replace(inner[0], "")
            for part in filter(None, (p.strip() for p in names.split(","))):
                self.imports.append((part.removeprefix("* as ").strip(), "*" if part.startswith("*") else "default", module))
        for m in re.finditer(r"""import\s+["']([^"']+)["']""", self.source):
            self.imports.append(("", "", m[1]))
        for m in re.finditer(r"""export\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s+from\s+["']([^"']+)["']""", self.source):
            self.imports.append(("", EXPORTED, m[1]))

    def relations(self) -> None:
        spans = sorted(self.nodes, key=lambda n: (n["start"], -n["end"]))
        found = self.found
        inside: list[dict] = []  # the declarations around a token, the innermost last
        begun = 0
        for i, (kind, text, offset) in enumerate(found):
            if kind != "name":
                continue
            while begun < len(spans) and spans[begun]["start"] <= offset:
                inside.append(spans[begun])
                begun += 1
            while inside and inside[-1]["end"] <= offset:
                inside.pop()
            before = found[i - 1][1] if i else ""
            after = found[i + 1][1] if i + 1 < len(found) else ""
            owner = inside[-1] if inside else None
            if owner is None:
                self.sites(i, "<file>", self.line(offset))
                continue
            if text == owner["name"] and offset - owner["start"] < 200 and before in ("class", "interface", "function", "enum", "type", "const", "let", "var", "namespace"):
                continue
            q = owner["qualified"]
            line = self.line(offset)
            self.sites(i, q, line)
            if before == "new":
                self.uses.append((q, "CREATES", text, line))
            elif before in ("extends", "implements"):
                self.uses.append((q, before.upper() if before == "extends" else "IMPLEMENTS", text, line))
            elif after == "(" and text not in NOT_CALLS and not (owner["name"] == text and owner["kind"] in ("method", "constructor", "function")):
                self.uses.append((q, "CALLS", text, line))
            elif text == "env" and before == "." and i >= 2 and found[i - 2][1] == "process" and after == "." and i + 2 < len(found):
                self.uses.append((q, "CONFIGURED_BY", found[i + 2][1], line))
            elif before == ":" and text[0].isupper():
                self.uses.append((q, "ACCEPTS" if after in (",", ")") else "RETURNS" if after == "{" else "REFERENCES", text, line))


    def sites(self, i: int, owner: str, line: int) -> None:
        """Note a route, request, event or use of a database whose call's name is at ``i``."""
        found = self.found
        at = lambda k: found[k][1] if 0 <= k < len(found) else ""
        if at(i) == "throw":
            end = next((k for k in range(i, min(i + 8, len(found))) if found[k][0] == "string"), None)
            if end is not None:
                self.uses.append((owner, "THROWS", found[end][1][1:-1][:200], line))
            return
        if at(i + 1) != "(":
            return
        name, root = at(i), at(i - 2) if at(i - 1) in (".", "?.") else ""
        chain = [name]
        k = i
        while at(k - 1) in (".", "?.") and k >= 2 and found[k - 2][0] == "name":
            k -= 2
            chain.append(at(k))
        literal = found[i + 2][1][1:-1] if i + 2 < len(found) and found[i + 2][0] == "string" else None
        if literal is not None and (name == "fetch" or chain[-1] in CLIENTS) and (name == "fetch" or name.upper() in HTTP_METHODS):
            method = "GET" if name == "fetch" else name.upper()
            if name == "fetch":
                options = [t[1] for t in found[i : closing(found, i + 1)]]
                method = next((options[j + 2][1:-1].upper() for j in range(len(options) - 2) if options[j] == "method" and options[j + 1] == ":"), method)
            self.uses.append((owner, "REQUESTS", f"{method} {literal}", line))
        elif literal is not None and root and name.upper() in HTTP_METHODS and literal.startswith("/"):
            route = f"{name.upper()} {literal}"
            self.uses.append((owner, "ROUTES", route, line))
            last = closing(found, i + 1)
            for j in range(i + 3, last):
                if found[j][0] == "name" and at(j - 1) in (",", ".") and at(j + 1) in (",", ")"):
                    self.uses.append((owner, "HANDLES", f"{route}\n{found[j][1]}", line))
        elif len(chain) >= 3 and chain[-1] in STORES or len(chain) >= 4 and chain[-2] in STORES:
            model = chain[1]
            for begin, kind in (("create", "CREATES"), ("update", "UPDATES"), ("upsert", "UPDATES"), ("delete", "DELETES"), ("find", "READS"), ("count", "READS"), ("aggregate", "READS")):
                if name.startswith(begin):
                    self.uses.append((owner, f"MODEL_{kind}", model, line))
                    break
        elif literal is not None and root and name in ("emit", "publish", "on", "subscribe", "add"):
            kind = "queue" if any("queue" in c.lower() for c in chain) else "event"
            self.uses.append((owner, "CONSUMES" if name in ("on", "subscribe") else "EMITS", f"{kind}:{literal}", line))


DECLARED = "file string, id string, kind string, name string, qualified_name string, owner_id string, start_line int, end_line int, start_offset int, end_offset int, exported boolean, signature string, imports array<struct<local:string,name:string,module:string>>, uses array<struct<owner:string,type:string,name:string,line:int>>"


def declarations(files: DataFrame) -> DataFrame:
    """One row per declaration of (path, language, content), and one for the file itself with its imports and uses.

    Offsets count UTF-16 units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ", 1)[0] for c in re.split(r", (?=\w+ )", re.sub(r"<.*?>>", "", DECLARED))]
        imports = pa.list_(pa.struct([("local", pa.string()), ("name", pa.string()), ("module", pa.string())]))
        uses = pa.list_(pa.struct([("owner", pa.string()), ("type", pa.string()), ("name", pa.string()), ("line", pa.int32())]))
        types = [pa.string()] * 6 + [pa.int32()] * 4 + [pa.bool_(), pa.string(), imports, uses]
        for b in batches:
            for path, language, content in zip(*[c.to_pylist() for c in b.columns], strict=True):
                source = content or ""
                scan = Scan(path, source)
                wide = [0]
                if not source.isascii():
                    for ch in source:
                        wide.append(wide[-1] + (2 if ord(ch) > 0xFFFF else 1))
                at = (lambda o, w=wide: w[o]) if len(wide) > 1 else (lambda o: o)
                key = lambda q, p=path, lang=language: f"{lang}:{p}:{q}"
                lines = source.count("\n") + 1
                rows = [(path, key("<file>"), "file", path.rsplit("/", 1)[-1], path, None, 1, lines, 0, at(len(source)), False, path, [{"local": a, "name": n, "module": m} for a, n, m in scan.imports], [{"owner": key(o), "type": t, "name": n, "line": x} for o, t, n, x in scan.uses])]
                rows += [(path, key(n["qualified"]), n["kind"], n["name"], n["qualified"], key(n["owner"] or "<file>"), n["start_line"], n["end_line"], at(n["start"]), at(n["end"]), n["exported"], n["signature"], [], []) for n in scan.nodes]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.where("not manifest").select("path", "language", "content").mapInArrow(run, DECLARED)


def extract(files: DataFrame) -> Graph:
    """The graph of source files (path, language, content, manifest)."""
    return resolve(declarations(files))


def resolve(rows: DataFrame) -> Graph:
    """The graph of the ``declarations`` of all files.

    A used name is resolved to the declaration of the same file, else to the imported one, else to the only exported
    method or function of that name among imported files. An edge is owned by the file of its source.
    """
    nodes = rows.select("id", "kind", "name", "qualified_name", "file", "start_line", "end_line", "start_offset", "end_offset", "signature", "exported", (F.lower("kind") == "route").alias("entry_point"))
    contains = rows.where("owner_id is not null").select(F.col("owner_id").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"), F.lit(None).cast("int").alias("line"))
    exports = rows.where("exported and owner_id like '%:<file>'").select(F.col("owner_id").alias("source"), F.col("id").alias("target"), F.lit("EXPORTS").alias("type"), F.lit(None).cast("int").alias("line"))
    file_rows = rows.where("kind = 'file'")

    directory = F.regexp_replace("file", r"/?[^/]*$", "")
    relative = F.filter(F.split(F.concat_ws("/", directory, "i.module"), "/", -1), lambda p: (p != ".") & (p != ""))
    folded = F.aggregate(relative, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.[cm]?[jt]sx?$", ""), r"(^|/)index$", "")
    imported = file_rows.select("file", F.col("id").alias("file_id"), F.explode("imports").alias("i")).where(F.col("i.module").startswith("."))
    imported = imported.select("file", "file_id", "i.local", F.col("i.name").alias("wanted"), stem(F.array_join(folded, "/")).alias("stem"))
    targets = file_rows.select(F.col("file").alias("from_file"), F.col("id").alias("from_id"), stem(F.col("file")).alias("stem"))
    linked = imported.join(targets, "stem")
    passed_on = F.when((F.col("local") == "") & (F.col("wanted") == EXPORTED), "EXPORTS").otherwise("IMPORTS")
    imports = linked.select(F.col("file_id").alias("source"), F.col("from_id").alias("target"), passed_on.alias("type"), F.lit(None).cast("int").alias("line")).distinct()

    every = file_rows.select("file", F.explode("uses").alias("u")).select("file", F.col("u.owner").alias("source"), F.col("u.type").alias("type"), F.col("u.name").alias("used"), F.col("u.line").alias("line"))
    sites = every.where(F.col("type").isin(*SITES) | F.col("type").startswith("MODEL_"))
    uses = every.where(~F.col("type").isin(*SITES) & ~F.col("type").startswith("MODEL_"))
    known = nodes.where("kind <> 'file'").select("id", "name", "kind", F.col("file").alias("from_file"), "exported")
    own = uses.alias("u").join(known.alias("k"), (F.col("u.file") == F.col("k.from_file")) & (F.col("u.used") == F.col("k.name"))).select("u.*", F.col("k.id").alias("target"), F.lit(0).alias("tier"))
    by_import = uses.join(linked.select("file", "from_file", F.col("local").alias("used"), "wanted"), ["file", "used"])
    by_import = by_import.join(known.select("from_file", F.col("name").alias("wanted"), F.col("id").alias("target")), ["from_file", "wanted"]).select(*uses.columns, "target", F.lit(1).alias("tier"))
    member = known.where("kind in ('method', 'function') and exported").select("from_file", F.col("name").alias("used"), F.col("id").alias("target"))
    by_member = uses.where("type = 'CALLS'").join(linked.select("file", "from_file").distinct(), "file").join(member, ["from_file", "used"]).select(*uses.columns, "target", F.lit(2).alias("tier"))
    fits = own.unionByName(by_import).unionByName(by_member).where("source <> target")
    keys = ["file", "source", "type", "used", "line"]
    best = fits.groupBy(*keys).agg(F.min("tier").alias("tier")).join(fits, [*keys, "tier"]).groupBy(*keys).agg(F.collect_set("target").alias("t")).where(F.size("t") == 1)
    resolved = best.select("source", F.get("t", F.lit(0)).alias("target"), "type", "line")
    tests = nodes.where("kind = 'test'").select(F.col("id").alias("source"))
    tested = resolved.where("type in ('CALLS', 'CREATES')").join(tests, "source", "left_semi").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("TESTED_BY").alias("type"), "line")
    settings = uses.where("type = 'CONFIGURED_BY'").select("source", F.concat(F.lit("config:"), "used").alias("target"), "type", "line")
    config = settings.select(F.col("target").alias("id")).distinct().select("id", F.lit("configuration").alias("kind"), F.substring("id", 8, 500).alias("name"))
    nodes = nodes.unionByName(config.withColumn("qualified_name", F.col("name")).withColumn("exported", F.lit(False)).withColumn("entry_point", F.lit(False)), allowMissingColumns=True)
    made, found_edges, thrown = _site_graph(sites, nodes)
    nodes = nodes.join(thrown, "id", "left").unionByName(made, allowMissingColumns=True)
    edges = contains.unionByName(found_edges).unionByName(exports).unionByName(imports).unionByName(resolved).unionByName(tested).unionByName(settings)
    edges = edges.groupBy("source", "target", "type").agg(F.min("line").alias("line"))
    sure = F.col("type").isin("CONTAINS", "EXPORTS")
    owned = edges.join(rows.select(F.col("id").alias("source"), F.col("file").alias("owner")).distinct(), "source", "left")
    return Graph(nodes, owned.withColumn("confidence", F.when(sure, 1.0).otherwise(0.75)).withColumn("evidence", F.when(sure, "deterministic").otherwise("heuristic")))


MASK = "<declaration-name>"
SHAPES = "file string, qualified_name string, kind string, exported boolean, hash string, masked string, header string"


def shapes(files: DataFrame) -> DataFrame:
    """(file, qualified_name, kind, exported, hash, masked, header) of the declarations of (path, language, content,
    manifest): digests of each one's source, and of it with its own name masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        names = [c.split()[0] for c in SHAPES.split(", ")]
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                scan = Scan(path, content or "")
                for n in scan.nodes:
                    own = scan.source[n["start"] : n["end"]]
                    masked = re.sub(rf"(?<![\w$]){re.escape(n['name'])}(?![\w$])", MASK, own, count=1)
                    rows.append((path, n["qualified"], n["kind"], n["exported"], digest(own), digest(masked), n["signature"]))
            types = [pa.bool_() if c == "exported" else pa.string() for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return files.where("not manifest").select("path", "content").mapInArrow(run, SHAPES)


SITES = ("ROUTES", "ROUTED_FROM", "HANDLES", "REQUESTS", "EMITS", "CONSUMES", "THROWS")


def _site_graph(sites: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``Scan.sites`` noted as nodes (routes, models, events, queues), edges, and (id, exceptions) of nodes."""
    none = F.lit(None).cast("int").alias("line")
    key = lambda kind, name: F.concat(F.lit(f"{kind}:"), name)
    routes = sites.where("type in ('ROUTES', 'ROUTED_FROM')").select("file", F.col("used").alias("name"), F.concat(F.lit("route:"), "file", F.lit(":"), "used").alias("id"), "source", "type", "line")
    models = sites.where("type like 'MODEL_%'").select("source", key("database_model", F.col("used")).alias("id"), F.col("used").alias("name"), F.regexp_replace("type", "^MODEL_", "").alias("type"), "line")
    kind, topic = F.split_part("used", F.lit(":"), F.lit(1)), F.regexp_replace("used", "^[a-z]+:", "")
    topics = sites.where("type in ('EMITS', 'CONSUMES')").select("source", F.col("used").alias("id"), kind.alias("kind"), topic.alias("name"), "type", "line")

    made = routes.select("id", F.lit("route").alias("kind"), "name", "file", F.col("name").alias("route"), F.lit(True).alias("entry_point"))
    made = made.unionByName(models.select("id", F.lit("database_model").alias("kind"), "name"), allowMissingColumns=True)
    made = made.unionByName(topics.select("id", "kind", "name"), allowMissingColumns=True).dropDuplicates(["id"])
    made = made.select("id", "kind", "name", "file", "route", F.col("name").alias("qualified_name"), F.lit(False).alias("exported"), F.coalesce("entry_point", F.lit(False)).alias("entry_point"))

    own = routes.where("type = 'ROUTED_FROM'").select(F.col("id").alias("route"), F.col("source").alias("handler"), "line")
    parts = F.split("used", "\n", 2)
    named = sites.where("type = 'HANDLES'").select("file", F.concat(F.lit("route:"), "file", F.lit(":"), parts[0]).alias("route"), parts[1].alias("name"), "line")
    one = nodes.where("kind in ('function', 'method')").groupBy("file", "name").agg(F.count("*").alias("n"), F.min("id").alias("handler")).where("n = 1")
    own = own.unionByName(named.join(one, ["file", "name"]).select("route", "handler", "line"))
    edges = own.select(F.col("route").alias("source"), F.col("handler").alias("target"), F.lit("CALLS").alias("type"), "line")
    edges = edges.unionByName(own.select(F.col("handler").alias("source"), F.col("route").alias("target"), F.lit("ROUTED_FROM").alias("type"), "line"))
    for t in (models, topics):
        edges = edges.unionByName(t.select("source", F.col("id").alias("target"), "type", "line"))
    thrown = sites.where("type = 'THROWS'").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("used")).alias("exceptions"))
    return made, edges.unionByName(edges.where("false").select("source", "target", "type", none)), thrown


def endpoints(rows: DataFrame) -> DataFrame:
    """(file, id, protocol, direction, method, address, setting, symbol_id, line): where the ``declarations`` of sources
    offer and ask over HTTP, and send and receive events. An address that begins with a setting names it."""
    every = rows.where("kind = 'file'").select("file", F.explode("uses").alias("u")).select("file", F.col("u.owner").alias("symbol_id"), F.col("u.type").alias("type"), F.col("u.name").alias("used"), F.col("u.line").alias("line"))
    http = every.where("type in ('ROUTES', 'ROUTED_FROM', 'REQUESTS')").withColumn("method", F.split_part("used", F.lit(" "), F.lit(1))).withColumn("whole", F.regexp_replace("used", r"^\S+ ", ""))
    based = r"^\$\{\s*process\.env\.(\w+)\s*\}"
    http = http.withColumn("setting", F.nullif(F.regexp_extract("whole", based, 1), F.lit(""))).withColumn("address", F.regexp_replace("whole", based, ""))
    direction = F.when(F.col("type") == "REQUESTS", "request").otherwise("provide")
    http = http.where(~F.col("address").contains("${")).select("file", F.lit("http").alias("protocol"), direction.alias("direction"), F.when(F.col("method") == "ALL", "*").otherwise(F.col("method")).alias("method"), "address", "setting", "symbol_id", "line")
    none = F.lit(None).cast("string")
    topics = every.where("type in ('EMITS', 'CONSUMES')").select("file", F.split_part("used", F.lit(":"), F.lit(1)).alias("protocol"), F.when(F.col("type") == "EMITS", "publish").otherwise("subscribe").alias("direction"), none.alias("method"), F.regexp_replace("used", "^[a-z]+:", "").alias("address"), none.alias("setting"), "symbol_id", "line")
    found = http.unionByName(topics)
    return found.withColumn("id", F.concat_ws("#", "file", "protocol", "direction", F.coalesce("method", F.lit("")), "address", "line"))


LANGUAGE = Language(declarations, resolve)
