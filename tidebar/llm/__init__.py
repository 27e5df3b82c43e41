"""Operators for training-data pipelines (text, urls, chats). Nothing else in the library imports this package."""
