"""Tagging, ownership, intents, matching and directions."""

import pytest

from tidemark.functions import attributes as A


@pytest.mark.parametrize(("text", "entity"), [
    ("My phone number is +1 555 123 4567", "phone_number"), ("my backup email is a@b.com", "backup_email"), ("I moved to Ghent last week", "location"), ("her mobile number is 555-000-1234 now", "other_phone_number"),
    ("my colleague Ann Lee's desk phone is 5551234999", "colleague_desk_phone"), ("We moved; my office is on the seventh floor now.", "office"), ("I drive a red Volvo", None), ("my wifi password is hunter2", "wifi_password"), ("The cat sat.", None), ("", None), (None, None),
    ("I am allergic to nuts", "allergy"), ("I run every morning", "routine"), ("call me Max", "name"), ("my new phone is blue", "phone_number"), ("my other phone is blue", "alternate_phone"),
])
def test_detect_entity(text, entity):
    assert A.detect_entity(text) == entity


def test_normalize():
    assert A.normalize_entity("  My Favourite--Café! ") == "my_favorite_caf"
    assert len(A.normalize_entity("x" * 90)) == 48 and A.normalize_entity(None) == ""
    assert A.normalize_slot("new phone number") == "phone_number" and A.normalize_slot("day") is None and A.normalize_slot("personal account just") == "personal_account"


def test_matching():
    assert A.entities_match("desk_phone", "desk_phone_number") and A.entities_match("home_address", "location") and A.entities_match("password", "wifi_password")
    assert not A.entities_match("account", "savings_account") and not A.entities_match("phone_number", "other_phone_number") and not A.entities_match("wifi_password", "router_admin_password")
    assert A.matching_names("location", ["home_address", "office", "other_location"]) == ["home_address"]
    assert A.is_single_valued("mobile") and A.is_single_valued("favorite_color") and not A.is_single_valued("other_mobile")


def test_questions():
    assert A.query_intents("what is my work address?")[0] == "work_address" and A.query_intents("what is her phone number?") == ("other_phone_number",)
    assert A.query_intents("how does tokenization work") == () and "location" in A.query_intents("where do I live?")
    assert A.self_name_tokens("My name is Ada Lovelace.") == {"ada", "lovelace"}


@pytest.mark.parametrize(("text", "direction"), [("what is my address?", "current"), ("what was my original address?", "oldest"), ("what was my number just before this one?", "previous"), ("what did I use to drive?", "historical"), ("what is my first name?", "current"), ("what was my first address?", "oldest")])
def test_direction(text, direction):
    assert A.query_direction(text) == direction


def test_resolve_direction():
    assert A.resolve_direction("previous", "what is it") == (True, "previous") and A.resolve_direction("latest", "what was my original x") == (False, "oldest")
    assert A.resolve_direction("current", "what was my original x") == (True, "oldest") and A.resolve_direction(None, "what is it") == (False, "oldest")


def test_anaphora():
    assert A.is_pronoun_led("It is now Bob") and not A.is_pronoun_led("They moved my desk") and not A.is_pronoun_led("The sea")
    assert A.inherit_entity("phone_number", "his is 123") == "other_phone_number" and A.inherit_entity("other_phone_number", "mine is 12") == "phone_number" and A.inherit_entity("pet", "it is 5") == "pet" and A.inherit_entity("", "x") is None


def test_cues():
    assert A.has_temporal_cue("what is it right now") and not A.has_temporal_cue("what is knowledge") and A.has_revision_marker("we switched banks") and not A.has_revision_marker("the snow")
