"""Queries over chunks, manifests and repositories: typing, filters, redaction, chunking, incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import paths as P
from quillspark.functions import redaction as R
from quillspark.functions import text as T
from quillspark.operators import chunking, incremental, state, units
from quillspark.session import table


def _chunks(spark: SparkSession, d: str, *columns: str, **worked_out: Column) -> DataFrame:
    """The chunks, each id once in its latest delivery. What is worked out of a row is worked out before rows of one id meet, so that texts aren't shuffled."""
    rows = table(spark, d, "code_chunks").filter("id is not null")
    return incremental.latest(rows.select("id", "indexed_at", *[c for c in columns if c not in ("id", "indexed_at")], *[e.alias(name) for name, e in worked_out.items()]), ["id"], "indexed_at")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def path_typing(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "files").select("path").distinct().select("path", P.suffix(p).alias("suffix"), P.language(p).alias("language"), P.category(p).alias("category"), P.indexable(p).alias("indexable"))


def typing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the category stored and the category that the path tells, with subtotals."""
    c = _chunks(spark, d, "category", told=P.category(F.col("path")))
    return c.rollup("category", "told").agg(F.count("*").alias("n_chunks"), F.grouping_id().cast("int").alias("level"))


def scalar_filter_scan(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").filter((F.lower("lang") == "go") & (F.col("category") == "code") & F.col("path").startswith("internal/"))
    return c.groupBy("repo_id").agg(F.countDistinct("id").alias("n_chunks"), F.countDistinct("path").alias("n_files"))


def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each file in order, numbered from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo_id", "path").orderBy("ordinal", "id")
    return _chunks(spark, d, "repo_id", "path", "ordinal", "start_line", "end_line").select("id", (F.row_number().over(w) - 1).alias("place"), "start_line", "end_line")


def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, subwords=F.array_join(T.subwords(F.coalesce("content", F.lit(""))), " ")).select("id", "subwords")


def indexed_text(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    mark = F.when((P.category(p) == "doc") | P.language(p).isNull() | P.language(p).isin(*units.HASH_COMMENTS), "#").otherwise("//")
    built = T.indexed_text(T.unit_header(mark, p, F.col("kind"), F.col("symbol"), F.col("parent_symbol")), F.col("context"), F.col("symbols"), F.col("content"))
    return _chunks(spark, d, sha=F.sha2(built, 256), n_bytes=F.octet_length(built).cast("bigint")).select("id", "sha", "n_bytes")


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos").select("id", T.slug(F.concat_ws(" ", "repo_name", "branch", "provider")).alias("slug"))


def path_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path").distinct().select("path", T.slug(F.col("path")).alias("slug"))


def byte_clips(spark: SparkSession, d: str) -> DataFrame:
    """Contents cut to 500 bytes: bytes left, which differ where a character would have been cut."""
    return _chunks(spark, d, n_bytes=F.octet_length(T.clip_bytes(F.col("content"), 500)).cast("bigint")).filter("n_bytes is not null").select("id", "n_bytes")


def line_slices(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, lines=T.line_slice(F.col("content"), 2, 3)).filter("lines is not null").select("id", "lines")


def _redacted(rows: DataFrame, *by: str) -> DataFrame:
    """``id``, ``by``, whether the text changed, the hash of what is left, and the redactions by label."""
    r = R.redacted(rows.filter("text is not null").withColumn("before", F.md5("text")), "text")
    n = [F.coalesce(F.element_at("redactions", label), F.lit(0)).cast("bigint").alias("n_" + label.strip("[]").lower()) for label in R.LABELS]
    return r.select("id", *by, (F.md5("text") != F.col("before")).alias("changed"), F.sha2("text", 256).alias("sha"), *n)


def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents after redaction: whether they changed, the hash of what is left, and the redactions by label."""
    return _redacted(_docs(spark, d))


def redact_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _redacted(table(spark, d, "code_chunks").filter("id is not null").select("id", "indexed_at", F.col("content").alias("text")), "indexed_at")
    return incremental.latest(rows, ["id"], "indexed_at").drop("indexed_at")


def redact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Redactions by repository and label."""
    rows = _redacted(table(spark, d, "code_chunks").filter("id is not null").select("id", "repo_id", "indexed_at", F.col("content").alias("text")), "repo_id", "indexed_at")
    once = incremental.latest(rows, ["id"], "indexed_at")
    return once.groupBy("repo_id").agg(*[F.sum(c).alias(c) for c in once.columns if c.startswith("n_")])


def content_hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.character_windows(_docs(spark, d)).select("id", "start", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("hash"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_sections(_docs(spark, d)).select("id", "section", "depth", "heading", "first_line", "last_line")


def section_trails(spark: SparkSession, d: str) -> DataFrame:
    """Headings of documents with the headings above them."""
    return chunking.section_trails(_docs(spark, d))


def line_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_windows(_docs(spark, d))


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(_docs(spark, d))


def _covered(parts: DataFrame, *keys: str) -> DataFrame:
    """By text: lines with something on them that the parts cover, parts above 2,000 bytes of several lines, and gaps in the numbers of parts."""
    lines = parts.select(*keys, F.posexplode(F.split("chunk", "\n", -1)).alias("i", "line"), "first_line").filter(F.col("line").rlike(r"[^\s]"))
    n = lines.select(*keys, F.col("first_line") + F.col("i")).distinct().groupBy(*keys).agg(F.count("*").alias("n_lines"))
    odd = parts.groupBy(*keys).agg(
        F.count_if((F.octet_length("chunk") > 2000) & (F.col("first_line") < F.col("last_line"))).alias("too_long"), (F.max("part") + 1 - F.count("*")).cast("bigint").alias("gaps"),
        F.count_if(F.size(F.split("chunk", "\n", -1)) != F.col("last_line") - F.col("first_line") + 1).alias("odd_lines"),
    )
    return n.join(odd, list(keys))


def line_windows_cover(spark: SparkSession, d: str) -> DataFrame:
    """That windows of lines lose no line, keep their limit and are numbered without gaps."""
    return _covered(line_windows(spark, d), "id")


def paragraphs_cover(spark: SparkSession, d: str) -> DataFrame:
    return _covered(paragraph_chunks(spark, d), "id")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return units.chunk_files(units.whole_files(table(spark, d, "code_chunks")))


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file cut anew into units, with the hash of each unit's text and header."""
    return _units(spark, d).select("repo_id", "path", "ordinal", "kind", "symbol", "parent_symbol", "start_line", "end_line", "part", "parts", "symbols", F.sha2(F.concat_ws("\n", "header", "text"), 256).alias("sha"))


def code_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of code by language and kind: how many, how many with a name, and their bytes."""
    u = _units(spark, d).select(P.language(F.col("path")).alias("language"), "kind", (F.col("symbol") != "").alias("named"), F.octet_length("text").alias("n")).filter("language is not null")
    return u.groupBy("language", "kind").agg(F.count("*").alias("n_units"), F.count_if("named").alias("n_named"), F.sum("n").alias("n_bytes"))


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Units of documents among the files."""
    return _units(spark, d).filter(P.category(F.col("path")) == "doc").select("repo_id", "path", "ordinal", "symbol", "parent_symbol", "start_line", "end_line", "part", "parts")


def units_cover(spark: SparkSession, d: str) -> DataFrame:
    """That the units of a file lose no line, keep their limit and are numbered without gaps."""
    u = _units(spark, d).select("repo_id", "path", F.col("ordinal").alias("part"), F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"), F.col("text").alias("chunk"))
    return _covered(u, "repo_id", "path")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return incremental.latest(table(spark, d, "files"), ["repo_id", "path"], "indexed_at")


def _held(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").filter("file_sha <> ''")
    return c.groupBy("repo_id", "path").agg(F.max_by("file_sha", F.struct("indexed_at", "file_sha")).alias("sha"))


def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).select("repo_id", "path", "sha", "chunk_count", "indexed_at")


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.manifest_diff(_held(spark, d), _manifest(spark, d))


def manifest_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).join(_held(spark, d), ["repo_id", "path"], "left_anti").select("repo_id", "path")


def sync_counters(spark: SparkSession, d: str) -> DataFrame:
    return incremental.counters(manifest_diff(spark, d))


def rewritten_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by repository after a run: those of changed and deleted files are taken out, those of new and changed files written."""
    chunks = _chunks(spark, d, "repo_id", "path")
    diff = manifest_diff(spark, d)
    fresh = chunks.join(diff.filter("state in ('added', 'modified')"), ["repo_id", "path"], "left_semi")
    kept = incremental.rewritten(chunks, diff, fresh)
    return kept.groupBy("repo_id").agg(F.count("*").alias("n_chunks"))


def rebuild_gate(spark: SparkSession, d: str) -> DataFrame:
    return incremental.needs_rebuild(table(spark, d, "repos"), "v8")


def repo_totals(spark: SparkSession, d: str) -> DataFrame:
    return state.repo_totals(table(spark, d, "files"))


def enrichment_cache(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by repository that a description is cached for (under their hash), and those without."""
    c = _chunks(spark, d, "repo_id", "chunk_hash", "context", "lang")
    # the language stands for the model here, the second part of the key
    cache = c.filter("context <> ''").select("chunk_hash", F.coalesce(F.lower("lang"), F.lit("")).alias("model"), "context")
    return incremental.cached_contexts(c.withColumn("model", F.coalesce(F.lower("lang"), F.lit(""))), cache).groupBy("repo_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def stats_of_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each repository, each run once: files and redactions in all, and the last reason."""
    s = incremental.latest(table(spark, d, "index_stats"), ["run_id"], "finished_at")
    return s.groupBy("repo_id").agg(
        F.count("*").alias("runs"), F.sum("files_seen").alias("files_seen"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("redactions"), F.max_by("reason", F.struct("finished_at", "run_id")).alias("last_reason")
    )


QUERIES = [
    path_typing, typing_counts, scalar_filter_scan, chunk_lookup, identifier_split, indexed_text, slugs, path_slugs, byte_clips, line_slices, redact_counts, redact_documents, redact_chunks, content_hash_duplicates,
    char_windows, markdown_sections, section_trails, line_windows, line_windows_cover, paragraph_chunks, paragraphs_cover, chunk_files, code_units, markdown_chunks, units_cover, manifest_latest, manifest_diff, manifest_deleted, sync_counters, rewritten_chunks, rebuild_gate, repo_totals, enrichment_cache, stats_of_runs,
]


def _latest(rows: str, keys: str, at: str, rest: list[str]) -> str:
    """The latest row of each key, ties by the other columns as text, like the operator."""
    tie = ", ".join(f"{c}::VARCHAR DESC NULLS LAST" for c in rest)
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {at} DESC NULLS LAST{', ' + tie if tie else ''}) AS r_ FROM {rows}) WHERE r_ = 1)"


_CHUNKS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS r_ FROM code_chunks) WHERE r_ = 1)"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SUFFIX = f"CASE WHEN ends_with({_NAME}, '.env.example') THEN '.env.example' ELSE lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) END"
# Written out here a second time, so that a wrong list in the operator shows.
_FLAT = """('.md', '.mdx', '.markdown', '.rst', '.txt', '.adoc', '.json', '.json5', '.jsonc', '.yml', '.yaml', '.toml', '.ini', '.cfg', '.conf', '.properties', '.env.example', '.xml', '.csproj', '.vbproj', '.fsproj', '.sqlproj',
  '.props', '.targets', '.sln', '.nuspec', '.config', '.xaml', '.plist', '.html', '.htm', '.css', '.scss', '.sass', '.less', '.hbs', '.handlebars', '.mustache', '.pug', '.haml', '.slim', '.jsp', '.aspx', '.ascx', '.master',
  '.sql', '.cob', '.cbl')"""
_NEVER = "('.csv', '.tsv', '.diff', '.patch', '.po', '.pot', '.log', '.ipynb', '.svg', '.pem', '.crt', '.key', '.pfx', '.p12')"
_LANGUAGE = f"""CASE {_NAME} WHEN 'Dockerfile' THEN 'dockerfile' WHEN 'Makefile' THEN 'make' WHEN 'Jenkinsfile' THEN 'groovy' WHEN 'go.mod' THEN 'gomod' WHEN 'BUILD' THEN 'starlark' WHEN 'WORKSPACE' THEN 'starlark' ELSE
  CASE WHEN ({_SUFFIX}) IN {_FLAT} OR ({_SUFFIX}) IN {_NEVER} THEN NULL
  WHEN ({_SUFFIX}) IN ('.ts', '.mts', '.cts') THEN 'typescript' WHEN ({_SUFFIX}) IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript' WHEN ({_SUFFIX}) IN ('.py', '.pyi') THEN 'python'
  WHEN ({_SUFFIX}) IN ('.rb', '.rake') THEN 'ruby' WHEN ({_SUFFIX}) IN ('.kt', '.kts') THEN 'kotlin' WHEN ({_SUFFIX}) IN ('.cc', '.cxx', '.hpp', '.hh', '.hxx') THEN 'cpp' WHEN ({_SUFFIX}) IN ('.m', '.mm') THEN 'objc'
  WHEN ({_SUFFIX}) IN ('.sh', '.bash', '.zsh') THEN 'bash' WHEN ({_SUFFIX}) IN ('.ps1', '.psm1', '.psd1') THEN 'powershell' WHEN ({_SUFFIX}) IN ('.fs', '.fsx', '.fsi') THEN 'fsharp' WHEN ({_SUFFIX}) IN ('.ex', '.exs') THEN 'elixir'
  WHEN ({_SUFFIX}) IN ('.erl', '.hrl') THEN 'erlang' WHEN ({_SUFFIX}) IN ('.ml', '.mli') THEN 'ocaml' WHEN ({_SUFFIX}) IN ('.pl', '.pm') THEN 'perl' WHEN ({_SUFFIX}) IN ('.clj', '.cljs', '.cljc') THEN 'clojure'
  WHEN ({_SUFFIX}) IN ('.groovy', '.gvy', '.gradle') THEN 'groovy' WHEN ({_SUFFIX}) IN ('.tf', '.tfvars') THEN 'terraform' WHEN ({_SUFFIX}) IN ('.bzl', '.bazel') THEN 'starlark' WHEN ({_SUFFIX}) IN ('.cu', '.cuh') THEN 'cuda'
  WHEN ({_SUFFIX}) IN ('.vert', '.frag') THEN 'glsl' WHEN ({_SUFFIX}) IN ('.sv', '.svh') THEN 'systemverilog' WHEN ({_SUFFIX}) IN ('.f90', '.f95', '.f03') THEN 'fortran' WHEN ({_SUFFIX}) IN ('.adb', '.ads') THEN 'ada'
  WHEN ({_SUFFIX}) IN ('.cls', '.trigger') THEN 'apex' WHEN ({_SUFFIX}) IN ('.j2', '.jinja', '.jinja2') THEN 'jinja2' WHEN ({_SUFFIX}) IN ('.erb', '.ejs') THEN 'embeddedtemplate'
  ELSE CASE {_SUFFIX} WHEN '.rs' THEN 'rust' WHEN '.cs' THEN 'csharp' WHEN '.cshtml' THEN 'razor' WHEN '.h' THEN 'c' WHEN '.hs' THEN 'haskell' WHEN '.jl' THEN 'julia' WHEN '.gql' THEN 'graphql' WHEN '.sol' THEN 'solidity'
  WHEN '.mk' THEN 'make' WHEN '.pas' THEN 'pascal' ELSE CASE WHEN ({_SUFFIX}) IN ('.tsx', '.c', '.cpp', '.go', '.java', '.php', '.swift', '.scala', '.dart', '.lua', '.vb', '.vue', '.svelte', '.astro', '.razor', '.twig', '.liquid',
  '.blade', '.graphql', '.proto', '.prisma', '.hcl', '.nix', '.zig', '.nim', '.elm', '.r', '.cmake') THEN substring({_SUFFIX}, 2) END END END END"""
_CATEGORY = f"CASE WHEN ({_SUFFIX}) IN ('.md', '.mdx', '.markdown', '.rst', '.txt', '.adoc') THEN 'doc' WHEN ({_SUFFIX}) IN ('.sql', '.cob', '.cbl') OR ({_LANGUAGE}) IS NOT NULL THEN 'code' ELSE 'other' END"
_IGNORED = f"""(list_has_any(string_split(path, '/')[:-2], ['.git', '.hg', '.svn', 'node_modules', 'bower_components', 'vendor', 'dist', 'build', 'out', 'target', 'bin', 'obj', 'coverage', '.next', '.nuxt', '.turbo', '.venv', 'venv',
  '__pycache__', '.pytest_cache', '.mypy_cache', '.ruff_cache', '.idea', '.vscode', '.gradle', '.dart_tool', 'Pods', 'DerivedData', 'packages', '__snapshots__', 'Connected Services', 'Service References'])
  OR {_NAME} IN ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'bun.lockb', 'bun.lock', 'uv.lock', 'poetry.lock', 'Cargo.lock', 'composer.lock', 'Gemfile.lock', 'go.sum', 'packages.lock.json')
  OR regexp_matches(lower({_NAME}), '(\\.min\\.js|\\.min\\.css|\\.bundle\\.js|\\.chunk\\.js|\\.map|\\.d\\.ts|\\.lock|-lock\\.json|-lock\\.yaml|\\.snap|\\.pb\\.go|\\.generated\\.cs|\\.g\\.cs|\\.g\\.i\\.cs|\\.designer\\.cs|\\.g\\.dart|\\.freezed\\.dart)$'))"""
_INDEXABLE = f"""(NOT {_IGNORED} AND ({_NAME} IN ('Dockerfile', 'Makefile', 'Jenkinsfile', 'Procfile', '.env.example', 'CODEOWNERS', 'BUILD', 'WORKSPACE')
  OR (({_SUFFIX}) <> '' AND ({_SUFFIX}) NOT IN {_NEVER} AND (({_SUFFIX}) IN {_FLAT} OR ({_LANGUAGE}) IS NOT NULL))))"""
def _subwords(text: str) -> str:
    spaced = f"regexp_replace(regexp_replace(array_to_string(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower({spaced}), '[ _]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^[0-9]+$')))), ' ')"


def _slug(expr: str) -> str:
    dashed = f"regexp_replace(regexp_replace(lower(translate({expr}, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    clipped = f"regexp_replace(substring({dashed}, 1, 60), '^-+|-+$', '', 'g')"
    return f"CASE WHEN {clipped} = '' THEN 'repo' ELSE {clipped} END"


_HELD = "(SELECT repo_id, path, arg_max(file_sha, struct_pack(a := indexed_at, b := file_sha)) AS sha FROM code_chunks WHERE file_sha <> '' GROUP BY ALL)"
_MANIFEST = _latest("files", "repo_id, path", "indexed_at", ["sha", "chunk_count"])
_DIFF = f"""(SELECT coalesce(f.repo_id, m.repo_id) AS repo_id, coalesce(f.path, m.path) AS path,
  CASE WHEN m.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'deleted' WHEN f.sha = m.sha THEN 'unchanged' ELSE 'modified' END AS state
  FROM {_HELD} f FULL OUTER JOIN {_MANIFEST} m ON f.repo_id = m.repo_id AND f.path = m.path)"""
# The rules of redaction written out once more: gaps and matches of a pattern are put together again.
_MAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_KEPT = r"(?i)@(?:example\.(?:com|net|org)|localhost|[\w.\-]+\.(?:test|invalid|example|local))$"
_SET = (
    r"\b(?:[A-Z][A-Z0-9]*_[A-Z0-9_]*(?:PASSWORD|SECRET|TOKEN|APIKEY|API_KEY|PRIVATE_KEY|PAT)[A-Z0-9_]*|(?:PASSWORD|SECRET|TOKEN|APIKEY|API_KEY|PRIVATE_KEY)[A-Z0-9_]*)\s*[:=]\s*"
    r"(?:\"[^\"\n]*\"|''[^''\n]*''|[^\s\"''#,;]+)"
)
_PART = r"regexp_replace(trim(regexp_replace(m, '^[A-Z0-9_]+\s*[:=]\s*', '')), '^[\"'']+|[\"'']+$', '', 'g')"
_IS_SECRET = rf"""(length({_PART}) >= 12 AND NOT regexp_matches({_PART}, '\s') AND regexp_matches({_PART}, '[0-9]') AND regexp_matches({_PART}, '[A-Za-z]')
  AND NOT regexp_matches({_PART}, '(?i)\b(?:process\.env|import\.meta\.env|os\.environ|env|Environment)\b') AND NOT regexp_matches({_PART}, '^\$\{{?') AND NOT regexp_matches({_PART}, '[.(]\s*$')
  AND NOT regexp_matches({_PART}, '^(?:string|number|boolean|text|varchar|uuid|jsonb?|any|unknown)\b') AND NOT regexp_matches({_PART}, '^[A-Za-z_][\w.]*\(') AND NOT regexp_matches({_PART}, '^(?:this|self)\.')
  AND NOT regexp_matches({_PART}, '^(?:https?|wss?|postgres(?:ql)?|redis|mongodb)://') AND NOT regexp_matches({_PART}, '(?i)(?:^<|your[-_]|change[-_]?me|placeholder|example|xxx+|\.\.\.)'))"""
_SHAPES = [
    r"\b(?:sk|pk|rk)-[A-Za-z0-9_\-]{16,}\b", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\b[a-z0-9]{52}\b",
]
_STEPS = ", ".join(f"k{i + 1} AS (SELECT id, orig, regexp_replace(t, '{p}', '[API_KEY]', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n FROM k{i})" for i, p in enumerate(_SHAPES))
_REDACTED = rf"""k0 AS (SELECT id, text AS orig, text AS t, 0 AS n FROM src), {_STEPS},
  j AS (SELECT id, orig, n, regexp_replace(t, '\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b', '[JWT]', 'g') AS t, len(regexp_extract_all(t, '\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\b')) AS nj FROM k5),
  e0 AS (SELECT *, string_split_regex(t, '{_MAIL}') AS g, regexp_extract_all(t, '{_MAIL}') AS ms FROM j),
  e AS (SELECT id, orig, n, nj, len(list_filter(ms, lambda m: NOT regexp_matches(m, '{_KEPT}'))) AS ne,
    CASE WHEN len(ms) = 0 THEN t ELSE array_to_string(list_transform(range(1, len(ms) + 1), lambda i: g[i] || CASE WHEN regexp_matches(ms[i], '{_KEPT}') THEN ms[i] ELSE '[EMAIL]' END), '') || g[len(ms) + 1] END AS t FROM e0),
  p1 AS (SELECT *, len(regexp_extract_all(t, '\+\d{{1,3}}[\s.\-]?\(?\d{{2,4}}\)?[\s.\-]?\d{{3}}[\s.\-]?\d{{2,4}}\b')) AS n1, regexp_replace(t, '\+\d{{1,3}}[\s.\-]?\(?\d{{2,4}}\)?[\s.\-]?\d{{3}}[\s.\-]?\d{{2,4}}\b', '[PHONE]', 'g') AS t1 FROM e),
  p2 AS (SELECT id, orig, n, nj, ne, n1 + len(regexp_extract_all(t1, '\b\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}\b')) AS np, regexp_replace(t1, '\b\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}\b', '[PHONE]', 'g') AS t FROM p1),
  s0 AS (SELECT *, string_split_regex(t, '{_SET}') AS g, regexp_extract_all(t, '{_SET}') AS ms FROM p2),
  s1 AS (SELECT *, list_transform(ms, lambda m: {_IS_SECRET}) AS hit FROM s0),
  redacted AS (SELECT id, t2 <> orig AS changed, sha256(t2) AS sha, n::BIGINT AS n_api_key, nj::BIGINT AS n_jwt, ne::BIGINT AS n_email, np::BIGINT AS n_phone, len(list_filter(hit, lambda h: h))::BIGINT AS n_secret FROM (
    SELECT *, CASE WHEN len(ms) = 0 THEN t ELSE array_to_string(list_transform(range(1, len(ms) + 1), lambda i: g[i] || CASE WHEN hit[i] THEN regexp_extract(ms[i], '^([A-Z0-9_]+\s*[:=]\s*)', 1) || '[SECRET]' ELSE ms[i] END), '')
      || g[len(ms) + 1] END AS t2 FROM s1))"""
_HEADING = r"^(#{1,6})[ \t]+(\S.*?)\s*$"
_DOC_LINES = r"""(SELECT id, count(*) AS n_lines, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS odd_lines FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
        WHERE regexp_matches(line, '[^\s\v]') GROUP BY id)"""

SQL = {
    "path_typing": f"SELECT path, {_SUFFIX} AS suffix, {_LANGUAGE} AS language, {_CATEGORY} AS category, {_INDEXABLE} AS indexable FROM (SELECT DISTINCT path FROM files)",
    "typing_counts": f"SELECT category, told, count(*) AS n_chunks, grouping(category, told)::INT AS level FROM (SELECT category, {_CATEGORY} AS told FROM {_CHUNKS}) GROUP BY ROLLUP (category, told)",
    "scalar_filter_scan": "SELECT repo_id, count(DISTINCT id) AS n_chunks, count(DISTINCT path) AS n_files FROM code_chunks WHERE lower(lang) = 'go' AND category = 'code' AND starts_with(path, 'internal/') GROUP BY repo_id",
    "chunk_lookup": f"SELECT id, row_number() OVER (PARTITION BY repo_id, path ORDER BY ordinal, id) - 1 AS place, start_line, end_line FROM {_CHUNKS}",
    "identifier_split": f"SELECT id, {_subwords("coalesce(content, '')")} AS subwords FROM {_CHUNKS}",
    "indexed_text": f"""WITH m AS (SELECT *, CASE WHEN ({_CATEGORY}) = 'doc' OR ({_LANGUAGE}) IS NULL OR ({_LANGUAGE}) IN ('python', 'ruby', 'bash', 'yaml', 'toml', 'r', 'perl', 'make', 'dockerfile', 'elixir', 'julia', 'powershell', 'terraform', 'starlark') THEN '#' ELSE '//' END AS mark FROM {_CHUNKS}),
        h AS (SELECT *, mark || ' file: ' || path || CASE WHEN symbol <> '' THEN chr(10) || mark || ' ' || coalesce(nullif(kind, ''), 'symbol') || ': ' || symbol || CASE WHEN parent_symbol <> '' THEN ' (in ' || parent_symbol || ')' ELSE '' END
          WHEN parent_symbol <> '' THEN chr(10) || mark || ' in: ' || parent_symbol ELSE '' END AS header FROM m),
        b AS (SELECT id, concat_ws(chr(10), header, nullif(context, ''), nullif(symbols, ''), nullif(content, ''), nullif({_subwords("header || chr(10) || coalesce(content, '')")}, '')) AS t FROM h) SELECT id, sha256(t) AS sha, octet_length(encode(t)) AS n_bytes FROM b""",
    "slugs": f"SELECT id, {_slug('concat_ws(chr(32), repo_name, branch, provider)')} AS slug FROM repos",
    "path_slugs": f"SELECT path, {_slug('path')} AS slug FROM (SELECT DISTINCT path FROM files)",
    "line_slices": f"SELECT id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS lines FROM {_CHUNKS} WHERE content IS NOT NULL",
    "byte_clips": f"""WITH b AS (SELECT id, octet_length(encode(content)) AS n, hex(encode(content)) AS h FROM {_CHUNKS} WHERE content IS NOT NULL)
        SELECT id, CASE WHEN n <= 500 THEN n WHEN substring(h, 1001, 2) NOT BETWEEN '80' AND 'BF' THEN 500 WHEN substring(h, 999, 2) NOT BETWEEN '80' AND 'BF' THEN 499
        WHEN substring(h, 997, 2) NOT BETWEEN '80' AND 'BF' THEN 498 ELSE 497 END::BIGINT AS n_bytes FROM b""",
    "redact_documents": f"WITH src AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_REDACTED} SELECT id, changed, sha, n_api_key, n_jwt, n_email, n_phone, n_secret FROM redacted",
    "redact_chunks": f"WITH src AS (SELECT id, content AS text FROM {_CHUNKS} WHERE content IS NOT NULL), {_REDACTED} SELECT id, changed, sha, n_api_key, n_jwt, n_email, n_phone, n_secret FROM redacted",
    "redact_counts": f"""WITH src AS (SELECT id, content AS text FROM {_CHUNKS} WHERE content IS NOT NULL), {_REDACTED} SELECT repo_id, sum(n_api_key)::BIGINT AS n_api_key, sum(n_jwt)::BIGINT AS n_jwt, sum(n_email)::BIGINT AS n_email,
        sum(n_phone)::BIGINT AS n_phone, sum(n_secret)::BIGINT AS n_secret FROM redacted JOIN {_CHUNKS} c USING (id) GROUP BY repo_id""",
    "content_hash_duplicates": "SELECT sha256(text) AS sha, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "char_windows": """SELECT id, start, length(chunk) AS n_chars, md5(chunk) AS hash FROM (SELECT id, start, substring(text, start + 1, 1000) AS chunk FROM (
        SELECT doc_id AS id, text, unnest(range(0, length(text), 800)) AS start FROM documents WHERE text <> ''))""",
    "markdown_sections": rf"""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        e AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS row_no, len(ls) AS n FROM l),
        h AS (SELECT * FROM e WHERE regexp_matches(line, '{_HEADING}') OR row_no = 0)
        SELECT id, row_number() OVER w AS section, length(regexp_extract(line, '{_HEADING}', 1)) AS depth, regexp_extract(line, '{_HEADING}', 2) AS heading, row_no + 1 AS first_line, coalesce(lead(row_no) OVER w, n) AS last_line
        FROM h WINDOW w AS (PARTITION BY id ORDER BY row_no)""",
    "section_trails": rf"""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l),
        h AS (SELECT id, list(struct_pack(d := length(regexp_extract(line, '{_HEADING}', 1)), p := [regexp_extract(line, '{_HEADING}', 2)]) ORDER BY n) AS hs, list(n ORDER BY n) AS ns FROM e WHERE regexp_matches(line, '{_HEADING}') GROUP BY id),
        i AS (SELECT id, hs, ns, unnest(range(1, len(hs) + 1)) AS k FROM h)
        SELECT id, ns[k]::INT AS first_line, array_to_string(list_reduce(hs[1:k], lambda a, x: struct_pack(d := x.d, p := list_concat(a.p[1:x.d - 1], x.p))).p, ' > ') AS trail FROM i""",
    "line_windows_cover": f"SELECT * FROM {_DOC_LINES}",
    "paragraphs_cover": f"SELECT * FROM {_DOC_LINES}",
    "units_cover": r"""SELECT repo_id, path, count(*) AS n_lines, 0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS odd_lines FROM (
        SELECT DISTINCT repo_id, path, n FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, start_line + generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM code_chunks WHERE content IS NOT NULL)
        WHERE regexp_matches(line, '[^\s\v]')) GROUP BY ALL""",
    "manifest_latest": f"SELECT repo_id, path, sha, chunk_count, indexed_at FROM {_MANIFEST}",
    "manifest_diff": f"SELECT repo_id, path, state FROM {_DIFF}",
    "manifest_deleted": f"SELECT repo_id, path FROM {_DIFF} WHERE state = 'deleted'",
    "sync_counters": f"""SELECT repo_id, count(*) FILTER (state <> 'deleted') AS files_seen, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'modified') AS modified,
        count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'unchanged') AS unchanged FROM {_DIFF} GROUP BY repo_id""",
    "rewritten_chunks": f"SELECT c.repo_id AS repo_id, count(*) AS n_chunks FROM {_CHUNKS} c ANTI JOIN (SELECT * FROM {_DIFF} WHERE state = 'deleted') x ON c.repo_id = x.repo_id AND c.path = x.path GROUP BY c.repo_id",
    "rebuild_gate": "SELECT id, index_version, coalesce(index_version, '') <> 'v8' AS rebuild FROM repos",
    "repo_totals": f"SELECT repo_id, count(*) AS file_count, coalesce(sum(chunk_count), 0)::BIGINT AS chunk_count FROM {_MANIFEST} GROUP BY repo_id",
    "enrichment_cache": f"""WITH c AS (SELECT *, coalesce(lower(lang), '') AS model FROM {_CHUNKS}), k AS (SELECT chunk_hash, model, max(context) AS x FROM c WHERE context <> '' GROUP BY ALL)
        SELECT repo_id, count(k.x) AS hits, count(*) - count(k.x) AS misses FROM c LEFT JOIN k USING (chunk_hash, model) GROUP BY repo_id""",
    "stats_of_runs": """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC NULLS LAST) AS r_ FROM index_stats) WHERE r_ = 1)
        SELECT repo_id, count(*) AS runs, sum(files_seen)::BIGINT AS files_seen, coalesce(sum(redactions), 0)::BIGINT AS redactions, arg_max(reason, struct_pack(a := finished_at, b := run_id)) AS last_reason FROM s GROUP BY repo_id""",
}
