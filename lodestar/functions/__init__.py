"""Column expressions: text in, text or numbers out, all inside whole-stage code."""
