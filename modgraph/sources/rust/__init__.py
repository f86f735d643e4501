"""Rust sources as relations: module declarations, items and references, parsed file by file."""
