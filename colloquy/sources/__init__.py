"""sources of the conversational-search engine."""
