"""Options and the ordered rules that operators are planned from."""
