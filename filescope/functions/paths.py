"""Scalar functions of paths: name, extension, kind, language, estimated tokens, order, and quoting for documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the classification, in the order in which they decide.
BUILD_DIRS = "target build dist node_modules __pycache__ .next .nuxt .gradle .tox .mypy_cache .pytest_cache".split()
TEST_DIRS = "test tests spec specs __tests__ fixtures testdata".split()
TEST_ENDS = "_test.rs _test.go _test.py _spec.rb _test.exs Test.java Tests.java Test.kt Tests.cs Test.cs Tests.swift Test.swift".split()
TEST_MARKS = [".test.", ".spec.", "_test."]
TEST_MARK_EXTS = "ts tsx js jsx mjs cjs mts cts dart".split()
LOCK_FILES = (
    "Cargo.lock package-lock.json yarn.lock pnpm-lock.yaml Gemfile.lock Pipfile.lock poetry.lock composer.lock go.sum uv.lock"
    " flake.lock Package.resolved bun.lock mix.lock pubspec.lock"
).split()
GENERATED_ENDS = ".generated.rs .gen.go .pb.go .pb.rs _pb2.py _pb2_grpc.py .g.dart .freezed.dart .min.js .min.css .js.map .css.map .d.ts.map".split()
CONFIG_NAMES = (
    "Cargo.toml Makefile makefile GNUmakefile CMakeLists.txt build.rs build.gradle build.gradle.kts settings.gradle"
    " settings.gradle.kts pom.xml package.json tsconfig.json jsconfig.json deno.json pyproject.toml setup.py setup.cfg tox.ini"
    " requirements.txt Pipfile go.mod go.work .gitignore .gitattributes .gitmodules .editorconfig .dockerignore .npmrc .nvmrc"
    " .prettierrc .eslintrc .eslintrc.json .eslintrc.js .babelrc Dockerfile Containerfile docker-compose.yml docker-compose.yaml"
    " compose.yaml Gemfile Rakefile Procfile Justfile justfile flake.nix Package.swift pubspec.yaml mix.exs .env"
).split()
CONFIG_STARTS = [".env.", "Dockerfile."]
CONFIG_EXTS = "toml yaml yml ini cfg conf env properties tf tfvars hcl cmake gradle plist editorconfig".split()
DOC_EXTS = "md markdown rst txt adoc org tex rtf".split()
DOC_STEMS = "LICENSE LICENCE COPYING NOTICE CHANGELOG CHANGES README CONTRIBUTING AUTHORS CODEOWNERS SECURITY".split()
DATA_EXTS = "json jsonl ndjson json5 jsonc csv tsv xml sif sql parquet avro svg geojson graphql gql".split()
BINARY_EXTS = (
    "png jpg jpeg gif bmp ico webp avif heic tif tiff psd woff woff2 ttf otf eot zip tar gz tgz bz2 xz zst 7z rar jar war exe dll"
    " so dylib a lib o obj rlib wasm class pyc pyd pdb bin db sqlite sqlite3 mp3 mp4 wav flac ogg m4a aac avi mov mkv webm pdf onnx"
    " pt safetensors gguf npy npz pkl lockb"
).split()
TEMPLATE_EXTS = "in j2 jinja jinja2 erb ejs hbs mustache tmpl tpl tt tt2".split()
SOURCE_EXTS = (
    "rs go py pyi pyx js mjs cjs ts mts cts tsx jsx c h cpp hpp cc cxx hh hxx ino java kt kts scala groovy clj cljs ex exs rb php"
    " swift m mm cs fs fsx vb zig nim v d lua pl pm sh bash zsh fish ps1 psm1 bat cmd css scss sass less styl html htm vue svelte"
    " astro r R jl hs ml mli erl hrl elm dart proto sol cr nix el scm rkt lisp vim f90 f95 asm s S cu glsl wgsl hlsl metal sil"
).split()
KINDS = ("source", "test", "config", "build", "doc", "data", "generated", "binary", "unknown")

#: Median bytes of a file by extension, and of any other.
MEDIAN_BYTES = {
    3000: "rs go java kt scala css scss less sql", 2500: "py rb php pl pm zig nim v d", 4000: "js ts tsx jsx md rst txt adoc",
    5000: "c cpp cc cxx html htm vue svelte", 2000: "h hpp lua ex exs erl hs ml mli elm proto", 3500: "swift m mm",
    1500: "sh bash zsh fish sil toml yaml yml json xml", 500: "ini cfg conf env", 10000: "csv tsv sif jsonl",
}
OTHER_BYTES = 2000

#: Language identifiers by name and by extension.
LANGUAGE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "make", "makefile": "make", "GNUmakefile": "make", "CMakeLists.txt": "cmake"}
LANGUAGES = {
    "rust": "rs", "python": "py pyi", "javascript": "js mjs cjs", "typescript": "ts mts cts", "tsx": "tsx", "jsx": "jsx", "go": "go",
    "c": "c h", "cpp": "cpp hpp cc cxx hh", "objective-c": "m mm", "java": "java", "kotlin": "kt kts", "scala": "scala",
    "swift": "swift", "csharp": "cs", "ruby": "rb", "php": "php", "bash": "sh bash", "zsh": "zsh", "fish": "fish",
    "powershell": "ps1 psm1", "lua": "lua", "sql": "sql", "html": "html htm", "css": "css", "scss": "scss", "less": "less",
    "markdown": "md markdown", "toml": "toml", "yaml": "yaml yml", "json": "json json5", "xml": "xml svg", "dart": "dart",
    "zig": "zig", "haskell": "hs", "elm": "elm", "elixir": "ex exs", "erlang": "erl hrl", "ocaml": "ml mli", "fsharp": "fs fsx",
    "clojure": "clj cljs", "r": "r R", "julia": "jl", "perl": "pl pm", "nix": "nix", "hcl": "tf", "protobuf": "proto",
    "graphql": "graphql gql", "vue": "vue", "svelte": "svelte", "sil": "sil", "sif": "sif",
}


def name(path: Column) -> Column:
    """The last component; empty for "", "/" and paths that end in "..": none."""
    return F.regexp_extract(path, r"([^/]+)/*\z", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, if something stands before it; else empty."""
    return F.regexp_extract(name(path), r"(?s)^.+\.([^.]*)\z", 1)


def parents(path: Column) -> Column:
    """Components above the last."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def order_key(path: Column) -> Column:
    """Paths in order component by component: a/b comes before a-b."""
    return F.split(path, "/")


def kind(path: Column) -> Column:
    """One of KINDS, for a file, by its directories, name and extension alone."""
    n, ext, up = name(path), extension(path), parents(path)

    def among(c: Column, values: list[str]) -> Column:
        return c.isin(values)

    def any_of(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    def below(dirs: list[str]) -> Column:
        return F.arrays_overlap(up, F.array(*map(F.lit, dirs)))

    test = any_of([below(TEST_DIRS), n.startswith("test_"), n == "conftest.py", *(n.endswith(x) for x in TEST_ENDS), any_of([n.contains(x) for x in TEST_MARKS]) & among(ext, TEST_MARK_EXTS)])
    rules = [
        ("unknown", (n == "") | (n == "..")),
        ("build", below(BUILD_DIRS)),
        ("test", test),
        ("generated", among(n, LOCK_FILES) | any_of([n.endswith(x) for x in GENERATED_ENDS])),
        ("config", among(n, CONFIG_NAMES) | any_of([n.startswith(x) for x in CONFIG_STARTS]) | among(ext, CONFIG_EXTS)),
        ("doc", among(ext, DOC_EXTS) | among(F.substring_index(n, ".", 1), DOC_STEMS)),
        ("data", among(ext, DATA_EXTS)),
        ("binary", among(ext, BINARY_EXTS)),
        ("generated", among(ext, TEMPLATE_EXTS)),
        ("source", among(ext, SOURCE_EXTS)),
    ]
    out = F
    for said, test in rules:
        out = out.when(test, F.lit(said))
    return out.otherwise(F.lit("unknown"))


def tokens(size: Column) -> Column:
    """Estimated tokens of so many bytes: one for each 3.5, rounded up."""
    return F.call_function("div", size.cast("bigint") * 2 + 6, F.lit(7))


def tokens_by_extension(path: Column) -> Column:
    """Estimated tokens where the size is not known."""
    ext, out = extension(path), F
    for size, exts in MEDIAN_BYTES.items():
        out = out.when(ext.isin(exts.split()), F.lit((size * 2 + 6) // 7))
    return out.otherwise(F.lit((OTHER_BYTES * 2 + 6) // 7)).cast("bigint")


def language(path: Column) -> Column:
    """Identifier of the language, or null."""
    by_name, by_ext = F, F
    for k, v in LANGUAGE_NAMES.items():
        by_name = by_name.when(name(path) == k, F.lit(v))
    for k, v in LANGUAGES.items():
        by_ext = by_ext.when(extension(path).isin(v.split()), F.lit(k))
    return F.coalesce(by_name, by_ext)


def quoted(s: Column) -> Column:
    """In double quotes, with control characters, quotes and backslashes escaped."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, said in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), *((chr(i), f"\\x{i:02x}") for i in range(32) if chr(i) not in "\n\t\r")):
        out = F.replace(out, F.lit(raw), F.lit(said))
    return F.concat(F.lit('"'), out, F.lit('"'))


def field(s: Column) -> Column:
    """A string as a record's field: quoted where it could be taken for something else."""
    return F.when(s.rlike(r"(?s)^\z|^_\z|^---\z|^[#§ ]|[ ]\z|[\p{Cc},\[\]{}\"\\]"), quoted(s)).otherwise(s)


def attribute(s: Column) -> Column:
    """A string as a directive's attribute: plain if it is visible ASCII without = \" or backslash."""
    return F.when(s.rlike(r'^[!#-<>-\[\]-~]+\z'), s).otherwise(quoted(s))


def datetime_text(t: Column) -> Column:
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("_"))


def number_text(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.coalesce(F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string")), F.lit("_"))
