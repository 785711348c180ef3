"""operators of the conversational-search engine."""
