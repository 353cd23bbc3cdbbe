"""The registered queries, by family."""

from . import evaluation, findings, language, relational, studies, texts  # noqa: F401
