"""Which files belong to an index, and why the others don't."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import basename, extension, matches_glob

# The default rules.
IGNORED_DIRS = """.git .hg .svn __pycache__ .venv venv env ENV .tox .nox .mypy_cache .ruff_cache .pytest_cache .pytype node_modules .next .nuxt .turbo
.parcel-cache .yarn .pnp dist build out target .gradle .mvn coverage .nyc_output htmlcov test-results playwright-report .idea .vscode .vs .cache .sass-cache""".split()
SECRETS = """.env .env.* *.pem *.key *.p12 *.pfx id_rsa id_dsa id_ecdsa id_ed25519 *.kdbx credentials.json secrets.json credentials .npmrc .pypirc .netrc
.pgpass token gh-token gitea-token gitlab-token auth.json service-account*.json *-credentials.json *.kubeconfig""".split()
NOT_SECRETS = ".env.example .env.template .env.sample .env.dist".split()
EXTENSIONS = """py pyi ipynb js jsx mjs cjs ts tsx vue svelte java kt kts scala groovy c h cpp cc cxx hpp hh m mm rs go swift zig rb php pl lua ex exs erl clj
cljs cs fs dart r jl sh bash zsh fish ps1 json jsonc toml yaml yml ini cfg conf xml html htm css scss sass less tf tfvars hcl bicep dockerfile sql graphql
gql proto prisma md mdx rst adoc txt""".split()
NAMES = """Dockerfile Containerfile Makefile GNUmakefile Rakefile Gemfile Procfile Vagrantfile Brewfile Justfile CMakeLists.txt BUILD WORKSPACE Cargo.toml
go.mod go.sum package.json pyproject.toml uv.lock poetry.lock Pipfile Pipfile.lock requirements.txt tsconfig.json README LICENSE NOTICE CHANGELOG""".split()
NOISE = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb composer.lock Gemfile.lock .terraform.lock.hcl".split()


@dataclass(frozen=True)
class Rules:
    max_bytes: int = 1_048_576
    ignored_dirs: list[str] = field(default_factory=lambda: IGNORED_DIRS)
    secrets: list[str] = field(default_factory=lambda: SECRETS)
    not_secrets: list[str] = field(default_factory=lambda: NOT_SECRETS)
    extensions: list[str] = field(default_factory=lambda: EXTENSIONS)
    names: list[str] = field(default_factory=lambda: NAMES)
    noise: list[str] = field(default_factory=lambda: NOISE)

    def merged(self, changes: dict) -> Rules:
        """Values are set and lists grow, or shrink under `remove_<name>`; a name that is unknown is an error."""
        out = self
        for name, value in changes.items():
            of, less = name.removeprefix("remove_"), name.startswith("remove_")
            if of not in self.__dataclass_fields__ or (less and not isinstance(getattr(self, of), list)):
                raise ValueError(f"unknown rule {name}")
            old = getattr(out, of)
            out = replace(out, **{of: value if not isinstance(old, list) else [x for x in old if x not in value] if less else list(dict.fromkeys([*old, *value]))})
        return out


def decision(path: Column, size: Column, head: Column, rules: Rules = Rules(), outside: Column | None = None, ignored: Column | None = None, link: Column | None = None) -> Column:
    """The first reason against a file, or ok: outside-project, ignored-directory, gitignore, secret, noise, unsupported-extension, symlink, missing, oversized, binary (a zero byte in the first 8192).

    Whether a path lies outside its project, a rule file ignores it, or it is a link, is told by the caller: see ignoring.ignored() and the workspace source. Nulls count as no.
    """
    outside, ignored, link = (F.lit(False) if c is None else c for c in (outside, ignored, link))
    leaf = basename(path)
    any_of = lambda globs: reduce(Column.__or__, [matches_glob(leaf, g) for g in globs], F.lit(False))
    named = leaf.isin(*rules.names)
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in rules.ignored_dirs]))
    return (
        F.when(outside, "outside-project").when(path == "", "ignored-directory").when(inside, "ignored-directory").when(ignored, "gitignore").when(any_of(rules.secrets) & ~any_of(rules.not_secrets), "secret").when(any_of(rules.noise) & ~named, "noise")
        .when(~extension(path).isin(*rules.extensions) & ~named & ~any_of(rules.not_secrets), "unsupported-extension").when(link, "symlink").when(size.isNull(), "missing").when(size > rules.max_bytes, "oversized")
        .when(F.instr(F.substring(head, 1, 8192), "\0") > 0, "binary").otherwise("ok")
    )


def not_indexable(files: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Recorded files (rel_path, size, head) that the rules no longer let in, with the reason."""
    return files.withColumn("reason", decision(F.col("rel_path"), F.col("size"), F.col("head"), rules)).where("reason <> 'ok'")
