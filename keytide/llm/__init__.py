"""Operators for preparing training text. Nothing else in keytide imports this subpackage."""
