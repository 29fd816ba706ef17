"""Operators for preparing training text: an optional subpackage that nothing else imports."""
