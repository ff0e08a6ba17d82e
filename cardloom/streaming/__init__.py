"""Extensions to streams."""
