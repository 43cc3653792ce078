"""Named queries built from the operators, each with an equivalent SQL text where SQL can say it."""
