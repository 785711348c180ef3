"""streaming of the conversational-search engine."""
