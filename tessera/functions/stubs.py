"""Small deterministic functions used as injected callables (X1, X3, ST5).
Kept in a module with no Spark imports so executors unpickle them cheaply."""


def stub_answer(question: str) -> str:
    """Stand-in for an answering agent: no model client is called."""
    if question.endswith("7"):
        raise ValueError("agent gave up")
    return "A:" + question[::-1]


def answer_chars(s: str) -> int:
    """Number of characters of each text of a Series."""
    return s.str.len()
