"""lodestone.sources"""
