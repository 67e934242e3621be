"""Operators on prompts, tools and documents; nothing else in the library imports this subpackage."""
