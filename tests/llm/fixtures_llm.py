"""Texts that every operator must stand: nulls, empty and long ones, ties and repeats."""

ODD = [None, "", " ", "\n\n", "one", "two words", "a b c d", "a b c d e", "x" * 5000, "word " * 3000, "é ß 日本 😀 ▁ z", "same text here now ok yes", "same text here now ok yes"]
