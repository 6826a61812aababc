"""Training of the personal-information tagger, in numpy.

    python -m factloom.llm.pii_train TABLES_DIR [TABLES_DIR ...]

Labelled spans are made, not collected: items of each kind are generated in many spellings with common or
invented names and numbers, wrapped in everyday phrases or put bare into running text. The surrounding text comes from
articles and documents of the given tables (not from the posts and comments the tagger is applied to) and from made chat
lines, dressed as people write them: without accents, in small letters, run on, with emoji. Made negatives
look like items without being any: order, block and invoice numbers, amounts, dates, versions, handles, wallets, firms,
places, job titles. The weights are written next to this module.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
import unicodedata
from pathlib import Path

import numpy as np

from factloom.llm import pii
from factloom.llm.charform import visual_form

ONSETS = "b c ch d đ g gi h k kh l m n ng nh ph qu s t th tr v x".split()
RIMES = "a an ang anh ao âm ân e en êu i iên inh iêm o oan ôn ông u uân ung uyên ương ưu y yên ỹ ạo ải ằng ế ịnh ọc ứ ường ấn ệp ĩ ụy ên uê am".split()
SURNAMES = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Trịnh Cao Tô Mai Lương Tạ Âu Mạc Khổng Thạch".split()
EN_A = "al ber cor dan el fen gar hal in jor kel liv mar nor os pel quen ro sab tam ul vos wex yel zan cal pet od".split()
EN_B = "a an en er in ia is la lo lum ma on or ra ric sa ta tin vin wen ys an dra sel".split()
EN_C = "worth by grave hall ley man marrow mere quay rick ridge sel stone ton way wick wood son ford".split()
STREETS = "Street Road Lane Avenue Court Drive Close Way Square Terrace Row Place".split()
HOSTS = "mail post quill box inbox letters hopthu nhantin thuhop webmail gmail outlook yahoo proton office uni work".split()
ENDS = "example test invalid com net vn org com.vn edu co.uk io de".split()
# Common given and family names, places, firms' and offices' words, months.
GIVEN_EN = (
    "John Mary James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George "
    "Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Frank Patrick Raymond Jack "
    "Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah "
    "Laura Anna Maria Emma Olivia Sophie Alice Grace Helen Rachel Diana Julia Victoria Peter Simon Oliver Harry Lucas Martin Carlos Juan Luis Jose Pedro Elena Sofia Ivan Ahmed Fatima Omar Wei"
).split()
FAMILY_EN = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson "
    "White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell "
    "Carter Roberts Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes Stewart Morris Morales Murphy Cook Rogers Cooper Peterson Reed Bailey Bell Kelly Howard "
    "Ward Cox Richardson Wood Watson Brooks Bennett Gray Hughes Price Myers Long Foster Sanders Ross Jordan Sullivan Fisher Henderson Coleman Graham Wallace Khan Patel Kim Chen Müller"
).split()
MIDDLE_VN = "Văn Thị Hữu Đức Minh Ngọc Thanh Quang Xuân Hoàng Thu Kim Đình Công Bảo Gia Phương Như Tuấn Anh".split()
GIVEN_VN = "An Anh Bình Châu Chi Cường Dung Dũng Giang Hà Hải Hạnh Hiền Hiếu Hoa Hòa Hùng Hương Huy Khánh Khoa Lan Linh Long Mai Minh Nam Nga Ngân Ngọc Nhung Phong Phúc Phương Quân Quỳnh Sơn Tâm Thảo Thắng Thủy Tiến Toàn Trang Trung Tú Tuấn Vân Việt Vy Yến".split()
PLACES = (
    "New York City|Los Angeles|San Francisco|United States|United Kingdom|Hong Kong|South Korea|North Sea|Hà Nội|Đà Nẵng|Hải Phòng|Cần Thơ|Hồ Chí Minh|Nha Trang|Bình Dương|Đồng Nai|Quảng Ninh|Việt Nam|"
    "Đông Nam Á|Saudi Arabia|New Zealand|Buenos Aires|Rio de Janeiro|Cape Town|Kuala Lumpur|Central Park|Wall Street|Silicon Valley|Middle East|Biển Đông|Tây Nguyên|Mekong Delta"
).split("|")
OFFICES = (
    "Federal Reserve|World Bank|Ngân hàng Nhà nước|Bộ Tài chính|Ủy ban Chứng khoán|European Union|Supreme Court|Bitcoin Cash|Ethereum Classic|Proof of Stake|Black Friday|Tết Nguyên Đán|Chủ Nhật|Microsoft Azure|"
    "Google Cloud|Chief Executive Officer|Board of Directors|Monday Morning|Tổng Giám đốc|Hội đồng Quản trị|Sở Giao dịch|White House|Wall Street Journal|Visa Direct|Red Cross|Premier League"
).split("|")
MONTH_NAMES = "January February March April May June July August September October November December".split()
FIRM_WORDS = "Bank Capital Group Holdings Ventures Partners Exchange Labs Network Protocol Finance Wallet Chain Token Coin Insurance Securities".split()
CARRIERS = {
    "email": ["email: {}", "e-mail {}", "mail: {}", "mail {}", "{}", "<{}>", "gửi vào mail {} nha", "mình dùng mail {}", "thư gửi về {} giúp mình", "ai cần file thì để lại hoặc viết tới {}", "reach me at {}", "you can email {}",
              "send the form to {}", "drop a line to {}", "reply to {}", "forward it to {}", "my address is {}", "hộp thư của mình: {}", "địa chỉ mail {}", "tài khoản {}", "contact: {}", "cc {}"],
    "phone": ["sđt {}", "SĐT: {}", "gọi số {}", "điện thoại: {}", "phone number {}", "số điện thoại là {}", "inbox hoặc gọi {}", "máy {}", "số mình {}", "số của em là {}", "đt {}", "điện thoại {}", "gọi {}", "gọi mình qua {}", "gọi lại cho anh theo số {}", "nhắn tin {}", "nhắn zalo {}", "zalo {}", "Zalo: {}", "lh {}", "liên hệ {}", "alo {}", "hotline {}",
              "phone {}", "Phone: {}", "tel. {}", "mobile {}", "cell {}", "call {}", "call me on {}", "ring {}", "text {}", "text me at {}", "WhatsApp {}", "whatsapp me {}", "reach me on {}", "my cell is {}", "her number: {}", "({})", "{}"],
    "id_number": ["CCCD {}", "cccd: {}", "số căn cước {}", "căn cước công dân {}", "CMND {}", "chứng minh nhân dân số {}", "số cmt {}", "giấy tờ: {}", "mã định danh cá nhân {}", "hộ chiếu {}", "passport {}", "passport number {}", "Passport No: {}",
                  "ID {}", "ID number {}", "national ID {}", "identity card {}", "SSN {}", "SSN: {}", "social security number {}", "social security {}", "so can cuoc {}", "so ho chieu {}", "Passport No. {}", "passport no. {}", "ID no. {}", "ID card no. {}", "identity no. {}", "CCCD số {}", "hộ chiếu số {}", "số định danh cá nhân {}", "personal number {}", "his social security number is {}", "CCCD của mình {}", "ID card: {}"],
    "address": ["địa chỉ {}", "Địa chỉ: {}", "đ/c {}", "ở {}", "mình ở {}", "trụ sở ghi là {}", "nhà ở {}", "giao hàng đến {}", "giao tới {}", "gửi đồ tới {}", "qua {} nhé", "tới {} lấy", "address {}", "Address: {}", "I live at {}", "we live at {}", "living at {}",
                "deliver to {}", "ship it to {}", "come to {}", "the house at {}", "at {}", "office: {}", "moved to {}", "mail it to {}", "{}"],
    "person": ["Ông {}", "ông {}", "Bà {}", "bà {}", "Anh {}", "anh {}", "Chị {}", "chị {}", "cô {}", "chú {}", "bạn {}", "em {}", "thầy {}", "mình là {}", "tôi là {}", "em tên {}", "tên: {}", "họ tên {}", "Họ và tên: {}", "người nhận {}", "chủ tài khoản {}",
               "chủ thẻ: {}", "nhân viên {}", "bác sĩ {}", "luật sư {}", "do {} gửi", "cảm ơn {}", "của {}", "với {}", "cho {}", "từ {}", "gặp {}", "{} gọi cho mình", "{} nói là", "{} bảo tôi", "{} đã nhận", "{} hứa", "{} lừa", "{} ký", "{} đại diện",
               "Mr {}", "Mr. {}", "Mrs {}", "Ms {}", "Ms. {}", "Dr {}", "Dr. {}", "Sir {}", "I am {}", "I'm {}", "this is {}", "name: {}", "Name: {}", "called {}", "named {}", "a man named {}", "thanks, {}", "best, {}", "sincerely, {}", "signed by {}", "by {}",
               "with {}", "from {}", "to {}", "for {}", "ask {}", "met {}", "told {}", "paid {}", "my friend {}", "manager {}", "agent {}", "account holder {}", "{} said", "{} told us", "{} called", "{} promised", "{} was appointed", "{} scored twice",
               "{} wrote", "{} took the money", "{} will join", "{} and his team", "{}, who runs it,", "{} is my neighbour", "he is {}", "she is {}", "known as {}", "goes by {}", "introduced himself as {}", "introduced herself as {}", "says his name is {}", "calls herself {}", "speak to {}", "look for {}", "cheated by {}", "thanked {}", "my landlord {}", "interview with {}",
               "our neighbour {}", "accountant {}", "{} still has not paid", "{} came", "a letter for {}", "contact {}", "tên thật là {}", "tìm {}", "giám đốc {}", "{} bị bắt", "{} khẳng định", "nhờ {} xác nhận", "thấy {} ở đó"],
}
# What is counted by long numbers that identify no person.
COUNTED = (
    "order|Order|invoice|ticket|ref|case|block|tracking|batch|job|height|nonce|shipment|serial|model|contract|epoch|mã đơn|đơn hàng|mã lệnh|khối|mã vận đơn|lệnh|phiếu|mã giao dịch|giao dịch|transaction|tx|hóa đơn|lô|sê-ri|hợp đồng|"
    "tài liệu|biên lai|quyết định|công văn|vé|mã sản phẩm|product|receipt|docket|report|message|log|device"
).split("|")
# Carriers after which even an invented name is a person's; the others take common names too.
BARE = ("{}", "{} and {}", "{} và {}", "{}, {}")
CHAT = (
    "ok|ok bạn|đúng rồi|chuẩn luôn|hay quá|mọi người ơi|cho hỏi chút|ai biết chỉ giúp|xin giá|còn hàng không|rút tiền mãi không được|sao chậm vậy|bài viết hữu ích|cảm ơn nhiều nha|đợi mãi|tin chuẩn không|lại lừa đảo nữa rồi|theo dõi tiếp|"
    "good point|nice|thank you|is this real|any update|same here|be careful|this is a scam|waiting for news|how long does it take|please help|never again|works for me|so true|what happened|can someone explain|first time here|good luck everyone"
).split("|")
EMOJI = "🚀 😂 🙏 🔥 📉 💎 😭 👍 ❤️ 😡".split()


def _syllable(r: random.Random) -> str:
    return unicodedata.normalize("NFC", (r.choice(ONSETS) + r.choice(RIMES)).capitalize())


def _english(r: random.Random, last: bool = False) -> str:
    return (r.choice(EN_A) + (r.choice(EN_C) if last else r.choice(EN_B))).capitalize()


def _plain(text: str) -> str:
    low = unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in low if not unicodedata.combining(c))


def _place(r: random.Random, n: tuple[int, ...] = (2, 2, 3)) -> str:
    return " ".join(_syllable(r) for _ in range(r.choice(n)))


def _figures(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _grouped(r: random.Random, digits: str) -> str:
    sep, sizes = r.choice([" ", ".", "-", " "]), r.choice([(4, 3, 3), (3, 3, 3, 3), (4, 4, 4), (2, 3, 3, 2), (3, 2, 2, 3), (3, 3, 4, 3), (3, 3, 6)])
    out, at = [], 0
    for s in sizes:
        if at < len(digits):
            out.append(digits[at : at + s])
            at += s
    return sep.join([*out, *([digits[at:]] if at < len(digits) else [])])


def _family(r: random.Random) -> str:
    """A common or an invented family name."""
    if r.random() < 0.5:
        return r.choice(FAMILY_EN)
    stem = r.choice("pet iv nov kow ok ad ros mor bel san mart fer whit har bro lind berg hoff ols kar nak tan sil dos cam wood ell as ber vel kov".split()) + r.choice(["", "", "a", "e", "i", "o"])
    return (stem + r.choice("ov ova ski sen son ez ini or field ton ford man er elli enko sson ley well a u ura moto for".split())).capitalize()


def _person(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.3:
        words = [r.choice(SURNAMES), *r.sample(MIDDLE_VN, r.choice([0, 1, 1, 1, 2])), r.choice(GIVEN_VN)]
    elif kind < 0.55:
        words = [r.choice(SURNAMES), *(_syllable(r) for _ in range(r.choice([1, 2, 2, 2])))]
    elif kind < 0.8:
        words = [r.choice(GIVEN_EN), *([r.choice("ABCDEFGHJKLMNPRSTW") + "."] if r.random() < 0.08 else []), _family(r)]
    else:
        words = [_english(r), _english(r, True) if r.random() < 0.85 else _syllable(r)]
    return " ".join(words)


def make(kind: str, r: random.Random) -> str:
    """One item of a kind."""
    if kind == "person":
        return _person(r)
    if kind == "email":
        parts = [re.sub("[^a-z0-9]", "", _plain(w).lower()) for w in _person(r).split()[-2:]]
        local = r.choice([".", "_", "-", ""]).join(parts) + r.choice(["", "", str(r.randint(1, 99)), str(r.randint(1960, 2010)), "+coin", "+x"])
        ends = [r.choice(HOSTS), *([r.choice(EN_A) + r.choice(EN_B)] if r.random() < 0.3 else []), r.choice(ENDS)]
        at, dot = r.choice([("@", ".")] * 6 + [(" @ ", "."), (" [at] ", " [dot] "), ("(at)", "."), (" [at] ", "."), ("@", " . "), (" at ", " dot ")])
        mail = local + at + dot.join(ends)
        return mail.upper() if r.random() < 0.1 else mail
    if kind == "phone":
        kind = r.random()
        if kind < 0.62:
            d = r.choice("3579") + _figures(r, 8)
            head = r.choice(["0", "0", "0", "0", "O", "+84", "+84 ", "84", "84", "0084 ", "(+84)", "(+84) "])
            body = d if r.random() < 0.45 else _grouped(r, d) if head.strip() not in ("0", "O") else ""
            if not body:
                return _grouped(r, head + d)
            return head + body
        if kind < 0.9:
            a, b, c, sep = r.choice("23456789") + _figures(r, 2), r.choice(["555", r.choice("23456789") + _figures(r, 2)]), _figures(r, 4), r.choice("-. ")
            return r.choice([f"({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"1 {a} {b} {c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])
        return r.choice([f"+44 20 {_figures(r, 4)} {_figures(r, 4)}", f"+44 7{_figures(r, 3)} {_figures(r, 6)}", f"+49 1{_figures(r, 2)} {_figures(r, 7)}", f"+33 6 {_figures(r, 2)} {_figures(r, 2)} {_figures(r, 2)} {_figures(r, 2)}", f"+65 {_figures(r, 4)} {_figures(r, 4)}", f"020 {_figures(r, 4)} {_figures(r, 4)}", f"024 {_figures(r, 4)} {_figures(r, 4)}"])
    if kind == "id_number":
        n = r.choice([9, 12, 12, 12, 8, 0, 3, 3])
        if n == 8:
            return r.choice("BCNPKEX") + _figures(r, r.choice([7, 7, 8]))
        if n == 3:
            return r.choice(["-", "-", "-", " "]).join([_figures(r, 3), _figures(r, 2), _figures(r, 4)])
        d = _figures(r, n or 12)
        return d if r.random() < 0.55 else _grouped(r, d)
    if r.random() < 0.6:
        no = f"{r.randint(1, 300)}{r.choice(['', '', '', 'A', 'B'])}"
        street = r.choice([_place(r), " ".join([r.choice(SURNAMES), r.choice(MIDDLE_VN), r.choice(GIVEN_VN)])])
        text = r.choice([
            f"số {no} đường {street}, phường {_place(r)}, {_place(r, (2,))}", f"số {no} đường {street}, phường {_place(r)}", f"{no} {street}, quận {r.randint(1, 12)}", f"{no} đường {street}, {r.choice(PLACES)}",
            f"{no}/{r.randint(1, 60)} hẻm {r.randint(1, 99)} phố {street}, P. {_place(r)}", f"{no} ngõ {r.randint(1, 300)} {street}, Q. {_place(r)}", f"{no}/{r.randint(1, 60)} {street}, P.{r.randint(1, 20)}, Q.{r.randint(1, 12)}",
            f"căn {_figures(r, 4)} chung cư {_english(r)}, {r.randint(1, 300)} {_place(r)}", f"nhà {no} ngõ {r.randint(1, 300)} {_place(r)}, Q. {_place(r)}",
            f"tổ {r.randint(1, 20)}, thôn {_place(r, (2,))}, xã {_place(r, (2,))}, huyện {_place(r, (2,))}",
        ])
        return _plain(text) if r.random() < 0.25 else text
    name = " ".join([*([r.choice(["Old", "North", "West", "Upper"])] if r.random() < 0.25 else []), r.choice([_english(r, True), _english(r), r.choice("Main Oak Maple Park Church High Elm Mill Station Victoria King Cedar Lake".split())]), r.choice([*STREETS, "St", "Ave", "Rd", "Blvd"])])
    text = f"{r.randint(1, 1200)}{r.choice(['', '', 'A', 'B'])} {name}"
    text = (f"{r.choice(['Flat', 'Apt', 'Unit', 'Suite'])} {r.randint(1, 40)}, " if r.random() < 0.3 else "") + text
    return text + r.choice(["", f", {_english(r, True)}", f", {_english(r, True)} {_figures(r, 5)}", f" {_figures(r, 2)}", f", {r.choice(['Springfield', 'Boston', 'Leeds', 'Austin'])}, {r.choice(['IL', 'MA', 'TX', 'CA'])} {_figures(r, 5)}"])


def harmless(r: random.Random) -> str:
    """A phrase that looks like an item and is none."""
    n = lambda *sizes: _figures(r, r.choice(sizes))
    y, m, d = r.randint(1990, 2026), r.randint(1, 12), r.randint(1, 28)
    firm = _english(r, r.random() < 0.3)
    return r.choice([
        lambda: f"{r.choice(COUNTED)}{r.choice([' ', ' ', ': ', ' #', ' số ', ' no. ', ' number ', ' so '])}{n(6, 7, 8, 9, 9, 10, 11, 12, 12, 13)}",
        lambda: r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}/{m:02}/{y}", f"{d}-{m}-{y}", f"{d}.{m}.{y}", f"{y}/{m}/{d}", f"{r.choice(MONTH_NAMES)} {d}, {y}", f"{d} {r.choice(MONTH_NAMES)} {y}", f"ngày {d} tháng {m} năm {y}", f"{y}{m:02}{d:02}", f"{y}-{m:02}-{d:02} {d:02}:{m:02}:00", f"{y}-{y + 1}"]),
        lambda: f"{r.choice(['', '$', '€', 'khoảng '])}{r.choice([n(1, 2, 3), f'{n(1, 2, 3)}.{n(3)}', f'{n(1, 2, 3)}.{n(3)}.{n(3)}', f'{n(1, 2, 3)},{n(3)},{n(3)}', f'{n(1, 2)},{n(1, 2)}', n(7, 8, 9)])} {r.choice(['đồng', 'triệu USD', 'tỷ đồng', 'thousand dollars', 'million', 'USD', 'tokens', 'VND', 'shares', 'coin', 'BTC', 'people', 'views', 'lượt xem'])}",
        lambda: f"{r.choice(['v', 'version ', 'bản ', 'phiên bản '])}{r.randint(0, 30)}.{r.randint(0, 20)}.{r.randint(0, 99)}",
        lambda: f"{r.choice(['', 'ví ', 'wallet ', 'địa chỉ ví ', 'hash '])}{r.choice(['0x', '', 'bc1q', 'T'])}{''.join(r.choice('0123456789abcdef') for _ in range(r.choice([24, 32, 40, 64])))}",
        lambda: f"{r.choice(['@', 'kênh @', 'follow @', 'tg @'])}{r.choice(EN_A)}{r.choice(EN_B)}{r.choice(['', '_vn', str(r.randint(1, 99)), '_official'])}",
        lambda: f"{r.choice(['in ', 'tại ', 'ở ', 'from ', 'tới ', ''])}{r.choice(PLACES)}", lambda: f"{r.choice(['the ', '', 'của ', 'theo ', 'at '])}{r.choice(OFFICES)}",
        lambda: f"{r.choice(['', 'the ', 'công ty ', 'sàn ', 'quỹ ', 'by '])}{firm} {r.choice(FIRM_WORDS)}", lambda: f"{firm} và {_english(r)}", lambda: f"{firm} ({''.join(r.choice('ABCDEFGHKLMNOPRSTUV') for _ in range(r.choice([3, 4])))})",
        lambda: f"{r.choice(['tỉnh', 'thành phố', 'vùng', 'khu', 'huyện', 'cao nguyên', 'the town of', 'the city of', 'the district of'])} {_place(r, (2,))}", lambda: f"{r.choice(['port', 'cổng', 'error', 'lỗi', 'room', 'phòng', 'chương', 'page', 'trang', 'season', 'quý', 'top'])} {n(1, 2, 3, 4)}",
        lambda: f"{r.choice(['https://', ''])}{r.choice(EN_A)}{r.choice(EN_B)}.{r.choice(['com', 'vn', 'net'])}/{r.choice(EN_A)}/{n(5, 8, 10)}", lambda: f"ISBN {n(13)}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
    ])()


SUSPECT = re.compile(r"@\S+\.\w|\[at\]|\(at\)| @ |(?i:sđt|zalo|whatsapp|phone|điện thoại|cccd|cmnd|căn cước|hộ chiếu|passport|ssn|địa chỉ|e-?mail|họ tên|\bông \w|\bbà \w|\bmrs?\b|my name)")


def dressed(text: str, r: random.Random) -> str:
    """A text as people write it in chats."""
    kind = r.random()
    if kind < 0.12:
        text = _plain(text)
    elif kind < 0.2:
        text = text[:1].lower() + text[1:]
    elif kind < 0.24:
        text = text.lower()
    if r.random() < 0.15:
        text = text.rstrip(".")
    if r.random() < 0.15:
        text = f"{text} {r.choice(EMOJI) * r.choice([1, 3])}"
    if r.random() < 0.25:
        text = f"{r.choice(CHAT)}{r.choice(['. ', ', ', '! ', '... ', ' '])}{text}"
    return text[:1].upper() + text[1:] if r.random() < 0.5 else text


def _put(text: str, spans: list[tuple[int, int, str]], phrase: str, own: list[tuple[int, int, str]], r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A phrase with its spans put somewhere between two words of a text."""
    left, right = r.choice([("(", ")"), ("- ", " -"), ("", ","), ("", ""), ("", ""), ("", "."), ("\n", "\n"), ("", " "), ("", " -"), ("; ", "")])
    gaps = [m.end() for m in re.finditer(r" ", text) if not any(a <= m.end() <= b for a, b, _ in spans)]
    where = r.choice([0, len(text), *(gaps or [0]), *(gaps or [0])])
    if any(a < where < b for a, b, _ in spans):
        return text, spans
    lead = "" if where == 0 or text[where - 1 : where].isspace() else " "
    tail = "" if where == len(text) or text[where : where + 1].isspace() else " "
    put = lead + left + phrase + right + tail
    begin = where + len(lead) + len(left)
    spans = [(a + len(put), b + len(put), k) if a >= where else (a, b, k) for a, b, k in spans]
    return text[:where] + put + text[where:], sorted(spans + [(begin + a, begin + b, k) for a, b, k in own])


def _phrase(kind: str, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A carrier of a kind, filled in; three in ten persons stand bare, several at times."""
    bare = kind == "person" and r.random() < 0.3
    carrier = r.choice(BARE) if bare else r.choice(CARRIERS[kind])
    if r.random() < 0.12 and kind in ("address", "person"):
        carrier = _plain(carrier)
    out, spans, at = "", [], 0
    for m in re.finditer(r"\{\}", carrier):
        item = make(kind, r)
        if bare:
            while item.split()[0] not in GIVEN_EN and item.split()[0] not in SURNAMES:
                item = make(kind, r)
        if kind == "person" and r.random() < 0.08:
            item = _plain(item).upper()
        elif kind == "person" and r.random() < 0.08:
            item = _plain(item)
        out += carrier[at : m.start()]
        spans.append((len(out), len(out) + len(item), kind))
        out, at = out + item, m.end()
    return out + carrier[at:], spans


def example(background: str, r: random.Random, items: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    """A background with up to three items and up to two harmless phrases put in, and the items' spans."""
    text, spans = background, []
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        text, spans = _put(text, spans, harmless(r), [], r)
    for _ in range(r.choice([1, 1, 1, 2, 2, 3]) if items else 0):
        text, spans = _put(text, spans, *_phrase(r.choice(pii.KINDS), r), r)
    return text, spans


def bio(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for a, b, kind in spans:
        k = pii.KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def dataset(texts: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, labels, mask) of windows, each (steps, windows)."""
    r = random.Random(seed)
    codes, labels, masks = [], [], []
    short = [t for t in texts if len(t) <= 60] or texts
    while len(codes) < n:
        base = r.random()
        text = r.choice(CHAT) if base < 0.12 else "" if base < 0.16 else r.choice(short if base < 0.35 else texts)
        if r.random() < 0.3:  # texts often run on without a period: a firm before a new sentence's first word is no name
            text = f"{text.rstrip('. ')} {r.choice(texts)}"
        text, spans = example(dressed(text, r), r, r.random() < 0.7)
        c, y = pii.encode(text), bio(text, spans)
        for s in pii.window_starts(len(c)):
            part = slice(s, min(s + pii.WINDOW, len(c)))
            if not y[part].any() and r.random() < 0.4:
                continue
            pad = pii.WINDOW - (part.stop - part.start)
            codes.append(np.pad(c[part], (0, pad)))
            labels.append(np.pad(y[part], (0, pad)))
            masks.append(np.arange(pii.WINDOW) < part.stop - part.start)
    return np.array(codes[:n]).T, np.array(labels[:n]).T, np.array(masks[:n]).T


def initial(hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    n = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    width = 12 + 4 + 4
    w = {"e_base": n(pii.N_BASE, 12) * 2, "e_tone": n(pii.N_TONES, 4), "e_shape": n(pii.SHAPES, 4), "out": n(2 * hidden, pii.N_LABELS), "out_b": np.zeros(pii.N_LABELS, np.float32)}
    for d in "fb":
        w |= {f"{d}_x": n(width, 4 * hidden), f"{d}_h": n(hidden, 4 * hidden), f"{d}_b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)}
    trans = np.zeros((pii.N_LABELS, pii.N_LABELS), np.float32)
    return w | {"trans": trans, "start": np.zeros(pii.N_LABELS, np.float32)}


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(w: dict, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    steps, n, _ = x.shape
    k = w[f"{d}_h"].shape[0]
    h, c, out, tape = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.zeros((steps, n, k), np.float32), []
    gx = x @ w[f"{d}_x"] + w[f"{d}_b"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = gx[t] + h @ w[f"{d}_h"]
        i, f, o, z = _sig(g[:, :k]), _sig(g[:, k : 2 * k]), _sig(g[:, 2 * k : 3 * k]), np.tanh(g[:, 3 * k :])
        c2 = f * c + i * z
        tc = np.tanh(c2)
        tape.append((t, h, c, i, f, o, z, tc))
        h, c = o * tc, c2
        out[t] = h
    return out, tape


def _lstm_back(w: dict, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    k = w[f"{d}_h"].shape[0]
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    dgx = np.zeros((*x.shape[:2], 4 * k), np.float32)
    for t, h, c, i, f, o, z, tc in reversed(tape):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * z * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)], axis=1)
        grad[f"{d}_h"] += h.T @ dg
        dgx[t] = dg
        dh, dc = dg @ w[f"{d}_h"].T, dc * f
    flat = dgx.reshape(-1, 4 * k)
    grad[f"{d}_x"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[f"{d}_b"] += flat.sum(0)
    return dgx @ w[f"{d}_x"].T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(w: dict, codes: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """CRF negative log-likelihood per window and its gradient."""
    a, b, s = pii.split_codes(codes)
    x = np.concatenate([w["e_base"][a], w["e_tone"][b], w["e_shape"][s]], axis=2)
    hf, tape_f = _lstm(w, "f", x, mask)
    hb, tape_b = _lstm(w, "b", x, mask)
    h = np.concatenate([hf, hb], axis=2)
    e = h @ w["out"] + w["out_b"]
    steps, n, m = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = e[0] + w["start"]
    for t in range(1, steps):
        alpha[t] = np.where(mask[t][:, None], _lse(alpha[t - 1][:, :, None] + w["trans"], 1) + e[t], alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(mask[t + 1][:, None], _lse(w["trans"] + (e[t + 1] + beta[t + 1])[:, None, :], 2), 0)
    z = _lse(alpha[-1], 1)
    at = np.arange(n)
    gold = e[0, at, y[0]] + w["start"][y[0]]
    marg = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["start"] = marg[0].sum(0)
    np.subtract.at(grad["start"], y[0], 1)
    for t in range(1, steps):
        live = mask[t]
        gold = gold + live * (e[t, at, y[t]] + w["trans"][y[t - 1], y[t]])
        p = np.exp(alpha[t - 1][:, :, None] + w["trans"] + (e[t] + beta[t])[:, None, :] - z[:, None, None]) * live[:, None, None]
        grad["trans"] += p.sum(0)
        np.subtract.at(grad["trans"], (y[t - 1][live], y[t][live]), 1)
    de = marg
    flat = de.reshape(-1, m)
    np.subtract.at(flat, (np.flatnonzero(mask.ravel()), y.ravel()[mask.ravel()]), 1)
    de = (flat.reshape(steps, n, m) / n).astype(np.float32)
    for k in ("start", "trans"):
        grad[k] = (grad[k] / n).astype(np.float32)
    grad["out"], grad["out_b"] = np.tensordot(h, de, ((0, 1), (0, 1))), de.sum((0, 1))
    dh, k = de @ w["out"].T, hf.shape[2]
    dx = _lstm_back(w, "f", x, tape_f, dh[:, :, :k], grad) + _lstm_back(w, "b", x, tape_b, dh[:, :, k:], grad)
    np.add.at(grad["e_base"], a, dx[:, :, :12])
    np.add.at(grad["e_tone"], b, dx[:, :, 12:16])
    np.add.at(grad["e_shape"], s, dx[:, :, 16:])
    return float((z - gold).mean()), grad


_shared: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _part(job: tuple[dict, np.ndarray]) -> tuple[float, dict]:
    w, at = job
    loss, grad = loss_and_gradient(w, *(x[:, at] for x in _shared))
    return loss * len(at), {k: v * len(at) for k, v in grad.items()}


def fit(data: tuple[np.ndarray, np.ndarray, np.ndarray], hidden: int = 28, epochs: int = 6, batch: int = 96, rate: float = 4e-3, seed: int = 0, say=print, workers: int = 1) -> dict[str, np.ndarray]:
    """Adam with a falling rate and clipped gradients; each batch is divided among ``workers`` processes."""
    global _shared
    _shared = data
    n, w = data[0].shape[1], initial(hidden, seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    g, step, total = np.random.default_rng(seed), 0, epochs * (n // batch)
    pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
    for epoch in range(epochs):
        order, losses = g.permutation(n), []
        for lo in range(0, len(order) - batch + 1, batch):
            jobs = [(w, at) for at in np.array_split(order[lo : lo + batch], workers)]
            parts = pool.map(_part, jobs) if pool else [_part(j) for j in jobs]
            loss = sum(p[0] for p in parts) / batch
            grad = {k: sum(p[1][k] for p in parts) / batch for k in w}
            norm = np.sqrt(sum(float((v**2).sum()) for v in grad.values()))
            step += 1
            now = rate * min(1, step / 100) * (1 - 0.95 * step / max(1, total))
            for k in w:
                gk = grad[k] * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] += 0.1 * (gk - m1[k])
                m2[k] += 0.002 * (gk * gk - m2[k])
                w[k] = (w[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        say(f"epoch {epoch + 1}: loss {np.mean(losses[-200:]):.4f}")
    if pool:
        pool.terminate()
    return w


def backgrounds(directories: list[str]) -> list[str]:
    """Sentences of articles and documents that look free of personal information, in their visual form."""
    import pandas as pd

    texts: dict[str, None] = {}
    for d in directories:
        for name, column in (("documents", "text"), ("web_posts", "content")):
            for text in pd.read_parquet(f"{d}/{name}.parquet", columns=[column])[column].dropna():
                for line in visual_form(text[:4000], True).split("\n"):
                    parts = re.split(r"(?<=[.!?]) ", line.strip())
                    for i in range(0, len(parts), 2):
                        texts[" ".join(parts[i : i + 2])[:280]] = None
    return sorted({f for f in texts if f.strip() and not SUSPECT.search(f)})


def main(directories: list[str], windows: int = 240_000, workers: int = 8) -> None:
    texts = backgrounds(directories)
    random.Random(3).shuffle(texts)
    held, texts = texts[:2000], texts[2000:]
    print(len(texts), "backgrounds", flush=True)
    w = fit(dataset(texts, windows, seed=1), epochs=8, batch=256, rate=8e-3, workers=workers, say=lambda s: print(s, flush=True))
    path = Path(__file__).with_name("pii_weights.npz")
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in w.items()})
    model = pii.Tagger(w)
    hits = {k: [0, 0, 0] for k in pii.KINDS}
    r = random.Random(99)
    tests = [example(dressed(r.choice(held), r), r) for _ in range(1500)]
    for (text, spans), labels in zip(tests, model.label([t for t, _ in tests]), strict=True):
        got, want = set(pii.spans_of(labels)), set(spans)
        for k in pii.KINDS:
            hits[k][0] += len({s for s in got & want if s[2] == k})
            hits[k][1] += len({s for s in got if s[2] == k})
            hits[k][2] += len({s for s in want if s[2] == k})
    for k, (both, got, want) in hits.items():
        print(f"{k}: precision {both / max(1, got):.3f}, recall {both / max(1, want):.3f} of {want} new spans")


if __name__ == "__main__":
    main(sys.argv[1:])
