"""Column expressions and the ordered-group primitives the operators build on."""
