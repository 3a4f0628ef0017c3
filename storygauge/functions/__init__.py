"""Column expressions: text, scale, neighbour JSON, model replies, prompts, similarity."""
