"""Projects of a source tree: where they start, their frameworks and package managers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .relational import checkpointed, outermost

#: kind -> manifests, the preferred first; ``*`` stands for any name.
MANIFESTS: dict[str, tuple[str, ...]] = {
    kind: tuple(names.split())
    for kind, names in {
        "node": "package.json",
        "python": "pyproject.toml setup.py setup.cfg requirements.txt",
        "java": "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts",
        "go": "go.mod go.work",
        "ruby": "Gemfile *.gemspec",
        "php": "composer.json wp-config.php",
        "csharp": "*.csproj *.sln Directory.Build.props Directory.Packages.props global.json",
    }.items()
}
#: kind -> (file, package manager), the preferred first.
LOCKS: dict[str, tuple[tuple[str, str], ...]] = {
    kind: tuple(tuple(p.split("=")) for p in pairs.split())
    for kind, pairs in {
        "node": "pnpm-lock.yaml=pnpm yarn.lock=yarn bun.lock=bun bun.lockb=bun package-lock.json=npm npm-shrinkwrap.json=npm",
        "python": "poetry.lock=poetry uv.lock=uv Pipfile.lock=pipenv Pipfile=pipenv pdm.lock=pdm requirements.txt=pip",
        "java": "pom.xml=maven build.gradle.kts=gradle-kts build.gradle=gradle",
        "go": "go.work=go-workspace go.mod=go-modules",
        "ruby": "Gemfile.lock=bundler Gemfile=bundler",
        "php": "composer.lock=composer composer.json=composer",
        "csharp": "packages.lock.json=nuget-locked *.csproj=nuget *.sln=nuget",
    }.items()
}
#: (kind, dependency, framework): equal names for the first kinds, parts of the manifest's text for the others.
EXACT_KINDS = ("node", "python", "ruby")
_BY_FRAMEWORK = {
    "node": "angular: @angular/core; astro: astro; express: express; fastify: fastify; hapi: @hapi/hapi hapi; koa: koa; nest: @nestjs/core; nextjs: next; react: react react-dom; "
    "remix: @remix-run/server-runtime remix; svelte: svelte; sveltekit: @sveltejs/kit; vue: @vue/runtime-core vue",
    "python": "aiohttp: aiohttp; bottle: bottle; celery: celery; django: django; fastapi: fastapi; flask: flask; quart: quart; starlette: starlette; tornado: tornado",
    "ruby": "grape: grape; hanami: hanami; rails: rails; sidekiq: sidekiq; sinatra: sinatra",
    "java": "jax-rs: jakarta.ws.rs; ktor: ktor; micronaut: micronaut; quarkus: quarkus; spring-boot: spring-boot",
    "go": "chi: go-chi/chi; echo: labstack/echo; fiber: gofiber/fiber; gin: gin-gonic/gin; gorilla: gorilla/mux",
    "php": "laravel: laravel/framework; slim: slim/slim; symfony: symfony/",
    "csharp": "aspnetcore: Microsoft.AspNetCore Microsoft.NET.Sdk.Web; azure-functions: Microsoft.Azure.Functions",
}
FRAMEWORKS = tuple((kind, dep, name) for kind, own in _BY_FRAMEWORK.items() for name, _, deps in (x.partition(": ") for x in own.split("; ")) for dep in deps.split())
_ENDINGS = (
    "typescript .ts .tsx; javascript .cjs .js .jsx .mjs; python .py .pyi; java .java; kotlin .kt .kts; go .go; ruby .gemspec .rake .rb; php .php .phtml; "
    "csharp .cs .cshtml .razor; bash .bash .sh; html .htm .html; yaml .yaml .yml; vue .vue; svelte .svelte"
)
LANGUAGES = {lang: tuple(ends) for lang, *ends in map(str.split, _ENDINGS.split(";"))}


def _is(name: Column, pattern: str) -> Column:
    return F.endswith(name, F.lit(pattern[1:])) if pattern.startswith("*") else name == pattern


def language_of(path: Column) -> Column:
    out = None
    for lang, ends in LANGUAGES.items():
        hit = F.lit(False)
        for e in ends:
            hit = hit | F.endswith(path, F.lit(e))
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


#: Endings that make a project of a tree without any manifest.
BARE = {".py": "python", ".java": "java", ".go": "go", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".sh": "bash"}


def _first(name: Column, patterns: tuple[str, ...]) -> Column:
    rank = F.when(_is(name, patterns[0]), 0)
    for i, p in enumerate(patterns[1:], 1):
        rank = rank.when(_is(name, p), i)
    return rank


def yaml_marks(files: DataFrame) -> DataFrame:
    """framework of ``files`` (path, and content or null) that configuration in YAML shows, by name or by its first characters."""
    path = F.col("path")
    mark = F.array_compact(F.array(
        F.when(F.rlike(path, F.lit(r"^[.]github/workflows/[^/]+[.]ya?ml$")), "github-actions"),
        F.when(F.rlike(path, F.lit(r"^(?:docker-)?compose[.]ya?ml$")), "docker-compose"),
        F.when(path == "Chart.yaml", "helm"),
        F.when(F.rlike(path, F.lit(r"[.]ya?ml$")) & text.is_cluster_manifest(F.coalesce("content", F.lit(""))), "kubernetes"),
    ))
    return files.select(F.explode(mark).alias("framework")).distinct()


def detect(files: DataFrame) -> DataFrame:
    """kind, dir, manifest, package_manager, workspace_member of the projects in ``files`` (path below the root; content, if there is one).

    Directories with a manifest are candidates; those below another of their kind go (every package of Node stays, but the root of a
    workspace; every C# project stays where no C# project lies above it, and a solution only with none below). A directory belongs to Node before
    all others. Then, where the root is no project, configuration in YAML makes one; where there is none at all, each language with
    files does; where there is none of these, pages do.
    """
    files = files if "content" in files.columns else files.withColumn("content", F.lit(None).cast("string"))
    named = files.select("path", F.substring_index("path", "/", -1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), "content")
    #: Drupal's mark lies three folders down.
    drupal = named.where(F.rlike("path", F.lit("(^|/)core/lib/Drupal[.]php$"))).select(F.regexp_replace("dir", "/?core/lib$", "").alias("dir"), F.lit("core/lib/Drupal.php").alias("manifest"))
    top = named.where("dir = ''")
    roots = top.where((F.col("name") == "pnpm-workspace.yaml") | ((F.col("name") == "package.json") & F.rlike(F.coalesce("content", F.lit("")), F.lit(r'"workspaces"\s*:'))))
    shared = roots.join(top.where("name = 'package.json'").select("dir"), "dir", "left_semi").select(F.lit(True).alias("shared")).limit(1)
    kinds = node = None
    for kind, manifests in MANIFESTS.items():
        own = named.withColumn("r", _first(F.col("name"), manifests)).where("r is not null").groupBy("dir").agg(F.min_by("name", F.struct("r", "name")).alias("manifest"))
        if kind == "php":
            own = own.unionByName(drupal.join(own.select("dir"), "dir", "left_anti"))
        if node is not None:
            own = own.join(node, "dir", "left_anti")
        if kind == "csharp":
            projects = own.where(F.endswith("manifest", F.lit(".csproj")))
            above = projects.select(F.explode(_above(F.col("dir"))).alias("dir")).distinct()
            bare = own.where(F.endswith("manifest", F.lit(".sln"))).join(above, "dir", "left_anti")
            own = projects.join(outermost(projects.select("dir"), "dir"), "dir", "left_semi").unionByName(bare)
        elif kind != "node":
            own = own.join(outermost(own.select("dir"), "dir"), "dir", "left_semi")
        found = named.withColumn("l", _first(F.col("name"), tuple(f for f, _ in LOCKS[kind]))).where("l is not null").groupBy("dir").agg(F.min("l").alias("l"))
        managers = F.array(*[F.lit(m) for _, m in LOCKS[kind]])
        if kind == "node":
            #: The root's lock file holds for all packages; in a workspace the root itself is none.
            l = F.coalesce(found.where("dir = ''").select("l").scalar(), F.lit(len(managers_of("node"))))
            member = F.coalesce(shared.scalar(), F.lit(False))
            rows = checkpointed(own.select("dir", "manifest", l.alias("l"), member.alias("workspace_member")).where("dir != '' or not workspace_member"))
            node = rows.select("dir")
        else:
            rows = own.join(found, "dir", "left").select("dir", "manifest", "l", F.lit(False).alias("workspace_member"))
        rows = rows.select(F.lit(kind).alias("kind"), "dir", "manifest", F.coalesce(F.try_element_at(managers, F.col("l") + 1), F.lit("unknown")).alias("package_manager"), "workspace_member")
        kinds = rows if kinds is None else kinds.unionByName(rows)
    kinds = checkpointed(kinds)  # a few rows, which each tier looks at
    shape = (F.lit("").alias("dir"), F.lit(None).cast("string").alias("manifest"), F.lit("unknown").alias("package_manager"), F.lit(False).alias("workspace_member"))
    at_root = kinds.where("dir = ''").select(F.lit(True).alias("x")).limit(1).scalar()
    config = yaml_marks(files).limit(1).select(F.lit("yaml").alias("kind"), *shape).where(at_root.isNull())
    known = kinds.unionByName(config)
    some = known.select(F.lit(True).alias("x")).limit(1).scalar()
    ending = F.create_map(*[F.lit(x) for pair in BARE.items() for x in pair])
    bare = files.select(F.try_element_at(ending, F.regexp_extract("path", r"([.][^./]+)$", 1)).alias("kind")).where("kind is not null").distinct()
    pages = files.where(F.rlike("path", F.lit("[.]html?$"))).limit(1).select(F.lit("html").alias("kind"))
    pages = pages.where(bare.select(F.lit(True).alias("x")).limit(1).scalar().isNull())
    return known.unionByName(bare.unionByName(pages).select("kind", *shape).where(some.isNull()))


def managers_of(kind: str) -> list[str]:
    return [m for _, m in LOCKS[kind]]


def _above(folder: Column) -> Column:
    """The folder and all above it, the root with an empty name."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


#: kind -> (manifest, pattern of a name in its text), the preferred first.
_NAMES = (
    ("node", "package.json", r'"name"\s*:\s*"([^"]+)"'),
    ("python", "pyproject.toml", r"(?ms)^\[(?:project|tool[.]poetry)\]\s*$(?:(?!^\[).)*?^name\s*=\s*['\"]([^'\"]+)['\"]"),
    ("python", "setup.cfg", r"(?im)^\s*name\s*=\s*([\w.-]+)\s*$"),
    ("python", "setup.py", r"name\s*=\s*['\"]([\w.-]+)['\"]"),
    ("java", "pom.xml", r"<artifactId>\s*([\w.-]+)\s*</artifactId>"),
    ("java", "settings.gradle", r"rootProject[.]name\s*=\s*['\"]([\w.-]+)['\"]"),
    ("java", "settings.gradle.kts", r"rootProject[.]name\s*=\s*['\"]([\w.-]+)['\"]"),
    ("go", "go.mod", r"(?m)^module\s+(?:\S*/)?([^\s/]+)\s*$"),
    ("ruby", "*.gemspec", r"[.]name\s*=\s*['\"]([\w.-]+)['\"]"),
    ("php", "composer.json", r'"name"\s*:\s*"(?:[^"/]*/)?([^"]+)"'),
    ("csharp", "*.csproj", r"<AssemblyName>\s*([^<\s]+)\s*</AssemblyName>"),
    ("csharp", "*.csproj", r"<RootNamespace>\s*([^<\s]+)\s*</RootNamespace>"),
)


def project_names(projects: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``projects`` (of ``detect``) with the name that their manifests give, else that of a C# manifest's file, else the folder's (at the root ``root``)."""
    named = files.select(F.substring_index("path", "/", -1).alias("f"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), "content")
    found = F.array_compact(F.array(*[
        F.when(_is(F.col("f"), m), F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.regexp_extract(F.coalesce("content", F.lit("")), pattern, 1).alias("name"))) for i, (kind, m, pattern) in enumerate(_NAMES)
    ]))
    own = named.select("dir", F.explode(found).alias("x")).where("x.name != ''")
    best = own.groupBy("dir", F.col("x.kind").alias("kind")).agg(F.min_by("x.name", "x.i").alias("name"))
    stem = F.when((F.col("kind") == "csharp") & F.rlike("manifest", F.lit("[.](?:csproj|sln)$")), F.regexp_replace("manifest", "[.][^.]+$", ""))
    folder = F.when(F.col("dir") == "", F.lit(root)).otherwise(F.substring_index("dir", "/", -1))
    return projects.join(best, ["dir", "kind"], "left").withColumn("name", F.coalesce("name", stem, folder))


def project_languages(projects: DataFrame, files: DataFrame) -> DataFrame:
    """kind, dir, languages (sorted) of all files below each project."""
    by_folder = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("f"), language_of(F.col("path")).alias("language")).where("language is not null").distinct()
    below = by_folder.select(F.explode(_above(F.col("f"))).alias("dir"), "language").distinct()
    root = below.where("dir = ''")
    every = below.where("dir != ''").unionByName(root)
    grouped = every.groupBy("dir").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    return projects.select("kind", "dir").join(grouped, "dir", "left").select("kind", "dir", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"))


#: kind -> (languages of which one must be there, the analyzer's language).
_ANALYZED = {"node": (("javascript", "typescript"), "javascript"), "python": (("python",), "python"), "java": (("java", "kotlin"), "java"), "go": (("go",), "go"), "ruby": (("ruby",), "ruby"), "csharp": (("csharp",), "csharp")}


def analyzed_language(kind: Column, languages: Column) -> Column:
    """The language that a query engine reads the project as, if its files have one of the kind's languages; else null."""
    out = None
    for own, (need, name) in _ANALYZED.items():
        hit = (kind == own) & F.arrays_overlap(languages, F.array(*map(F.lit, need)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def files_per_language(files: DataFrame, by: list[str]) -> DataFrame:
    """Files of each language, and of the JVM the language that a graph engine reads: Kotlin's where it has more files than Java."""
    counted = files.withColumn("language", language_of(F.col("path"))).where("language is not null")
    counts = counted.groupBy(*by, "language").agg(F.count("*").alias("files"))
    of = lambda k: F.count(F.when(F.col("language") == k, 1))
    jvm = counted.groupBy(*by).agg(F.when(of("kotlin") > of("java"), "kotlin").when(of("java") > 0, "java").alias("jvm"))
    return counts.join(jvm, by)


def by_path(projects: DataFrame) -> DataFrame:
    """Projects in the order of their folders, the root first."""
    return projects.orderBy("dir", "kind")


def frameworks(dependencies: DataFrame) -> DataFrame:
    """project, framework of ``dependencies`` (project, kind, name): by name, or by a part of it."""
    spark = dependencies.sparkSession
    table = spark.createDataFrame(list(FRAMEWORKS), "kind STRING, dep STRING, framework STRING")
    plain = dependencies.withColumn("dep", F.when(F.col("kind") == "node", F.col("name")).otherwise(text.dependency_name(F.col("name"))))
    exact = plain.where(F.col("kind").isin(*EXACT_KINDS)).join(table, ["kind", "dep"])
    part = dependencies.where(~F.col("kind").isin(*EXACT_KINDS)).join(table, "kind").where(F.expr("contains(name, dep)"))
    return exact.select("project", "framework").unionByName(part.select("project", "framework")).distinct()
