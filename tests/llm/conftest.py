from llm_fixtures import docs, nothing, small  # noqa: F401
