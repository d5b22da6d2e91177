"""SQL twins of the noise operators."""
from queries.fixtures import q_draw, q_parse_date


def q_letter(purpose, key, k, base=97):
    return f"chr(({base} + {q_draw(purpose, key, k)} % 26)::INT)"


def q_typo(value, purpose, key="unique_id"):
    place = f"({q_draw(purpose, key, chr(39) + '1' + chr(39))} % length({value}))::INT"
    change = f"substr({value}, 1, {place}) || {q_letter(purpose, key, chr(39) + '2' + chr(39))} || substr({value}, {place} + 2)"
    return f"CASE WHEN length({value}) < 2 THEN {value} ELSE {change} END"


def q_user(value):
    return f"split_part({value}, '@', 1)"


def q_email_variant(value, purpose, key="unique_id"):
    user = q_user(value)
    domain = f"substr({value}, instr({value}, '@') + 1)"
    number = f"({q_draw(purpose, key, quote(2))} % 99 + 1)::VARCHAR"
    return (f"CASE WHEN instr({value}, '@') > 0 THEN CASE {q_draw(purpose, key, quote(1))} % 4 "
            f"WHEN 0 THEN replace({user}, '.', '') || '@' || {domain} WHEN 1 THEN {user} || {number} || '@' || {domain} "
            f"WHEN 2 THEN {user} || '@gmail.com' ELSE {user} || '@outlook.com' END ELSE {value} END")


def quote(x):
    return f"'{x}'"


def q_email_digit(value, purpose, key="unique_id"):
    digit = f"({q_draw(purpose, key, quote(1))} % 9 + 1)::VARCHAR"
    return (f"CASE WHEN instr({value}, '@') > 0 THEN {q_user(value)} || {digit} || substr({value}, instr({value}, '@')) "
            f"ELSE {value} || {digit} END")


def q_short_place(value):
    known = ("CASE {v} WHEN 'New York' THEN 'NYC' WHEN 'Los Angeles' THEN 'LA' WHEN 'San Francisco' THEN 'SF' "
             "WHEN 'Saint Louis' THEN 'St Louis' WHEN 'Saint Paul' THEN 'St Paul' WHEN 'Washington' THEN 'DC' END").format(v=value)
    initials = f"array_to_string(list_transform(string_split({value}, ' '), lambda w: upper(substr(w, 1, 1))), '')"
    return f"coalesce({known}, CASE WHEN contains({value}, ' ') THEN {initials} ELSE {value} END)"


def q_clipped_place(value):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (f"CASE WHEN length({value}) > 3 THEN upper(substr({value}, 1, 3)) "
            f"ELSE translate({value}, '{upper}{lower}', '{lower}{upper}') END")


def q_other_code(value, codes, purpose, key="unique_id"):
    every = "[" + ", ".join(quote(c) for c in codes) + "]"
    rest = f"list_filter({every}, lambda c: c <> upper(trim({value})))"
    return f"CASE WHEN {value} IS NOT NULL THEN {rest}[({q_draw(purpose, key, quote(1))} % len({rest}) + 1)::INT] END"


def q_flip_gender(value, purpose, key="unique_id"):
    return f"CASE {value} WHEN 'M' THEN 'F' WHEN 'F' THEN 'M' ELSE ['M', 'F'][({q_draw(purpose, key, quote(1))} % 2 + 1)::INT] END"


def q_other_gender(value, purpose, key="unique_id"):
    now = f"CASE WHEN contains(upper({value}), 'M') THEN 'M' WHEN contains(upper({value}), 'F') THEN 'F' ELSE 'U' END"
    rest = f"list_filter(['M', 'F', 'U'], lambda c: c <> {now})"
    return f"{rest}[({q_draw(purpose, key, quote(1))} % 2 + 1)::INT]"


def q_scramble(value, purpose, key="unique_id"):
    change = (f"list_transform(string_split({value}, ''), lambda ch, i: CASE WHEN {q_draw(purpose, key, '(i - 1)::VARCHAR')} % 2 = 0 "
              f"THEN ch ELSE {q_letter(purpose, key, '(i + 999)::VARCHAR')} END)")
    return f"CASE WHEN length({value}) <= 1 THEN {value} ELSE array_to_string({change}, '') END"


def q_last_char(value, purpose, key="unique_id"):
    return (f"CASE WHEN length({value}) > 1 THEN substr({value}, 1, length({value}) - 1) || {q_letter(purpose, key, quote(1))} "
            f"ELSE {value} END")


def q_change_letters(value, n, purpose, key="unique_id"):
    places = f"list_filter(range(1, length({value}) + 1), lambda i: regexp_matches(substr({value}, i, 1), '[A-Za-z]'))"
    ranked = f"list_sort(list_transform({places}, lambda i: {{'h': {q_draw(purpose, key, 'i::VARCHAR')}, 'i': i}}))"
    chosen = f"list_transform({ranked}[1:{n}], lambda s: s.i)"
    step = q_draw(purpose, key, "(j + 1000)::VARCHAR")
    turn = lambda base: f"chr(((ascii(ch) - {base} + 1 + {step} % 25) % 26 + {base})::INT)"
    change = (f"list_transform(string_split({value}, ''), lambda ch, j: CASE WHEN NOT list_contains({chosen}, j) THEN ch "
              f"WHEN regexp_matches(ch, '[a-z]') THEN {turn(97)} ELSE {turn(65)} END)")
    return f"CASE WHEN len({places}) > 0 THEN array_to_string({change}, '') ELSE {value} END"


def q_shift_date(value):
    day = q_parse_date(f"trim({value})")
    first = f"make_date(year({day}), month({day}) % 12 + 1, 1)"
    moved = f"make_date(year({first}), month({first}), least(day({day}) + 1, day(last_day({first}))))"
    return f"coalesce(strftime({moved}, '%Y-%m-%d'), {value})"


def q_shift_year(value, purpose, key="unique_id", shift=1):
    sign = f"CASE WHEN {q_draw(purpose, key, quote(1))} % 2 = 0 THEN 1 ELSE -1 END"
    return f"CASE WHEN regexp_full_match(trim({value}), '[+-]?[0-9]{{1,9}}') THEN (trim({value})::INT + {sign} * {shift})::VARCHAR ELSE {value} END"


def q_synthetic(value, purpose, key="unique_id"):
    n = f"({q_draw(purpose, key, quote(1))} % 98 + 1)::VARCHAR"
    return f"replace(upper(substr({value}, 1, 2)), ' ', 'X') || {n} || ' ' || {n} || 'AB'"
