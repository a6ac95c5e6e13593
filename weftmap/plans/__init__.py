"""Programs: their text, what they mean, and running them; profiles of sources and models inferred from them."""
